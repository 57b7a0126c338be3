"""Token ids of whole texts, remembered word by word.

The tokenizer never merges across white space and drops it, so the ids of a text are those of its words in order.
A task keeps the ids of words it has met, in two generations of bounded size. Of new words, plain ones (Latin letters
with or without ASCII punctuation at the end) go straight to the vocabulary's merges as the one or two stretches
that the pre-tokenizer would make of them; all others go through the library's whole encoding.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered in a generation, and the longest word that is.
REMEMBERED = 250_000
LONGEST = 64
#: ASCII punctuation that may end a plain word, one stretch of the pre-tokenizer, and how many such ends are remembered.
ENDS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
ENDS_REMEMBERED = 10_000
#: Words whose ids are put in place at a time.
WORDS = 1 << 20
#: Characters below this are letters of Latin scripts, or none.
LATIN = "ɐ"


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for characters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _bytes_of(strings: pa.LargeStringArray) -> list[bytes]:
    _, offsets, data = strings.buffers()
    bounds = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1].tolist()
    held = data.to_pybytes() if data else b""
    return [held[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class WordIds:
    """Little-endian 32-bit ids of texts by a `tokenizers` file that lower-cases, drops white space and keeps letters
    apart from other characters."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.ends: dict[bytes, bytes] = {}
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _direct(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _letters(self, word: bytes) -> bytes | None:
        """Ids of a word of Latin letters, None for any other."""
        if not word.isalpha():  # ASCII letters
            text = word.decode("utf-8", "surrogatepass")
            if not (text.isalpha() and max(text) < LATIN and unicodedata.is_normalized("NFC", text)):
                return None
            lower = text.lower()
            if len(lower) != len(text) or not lower.isalpha():
                return None
            mapped = lower.encode().decode("latin-1").translate(self.alphabet)
        else:
            mapped = word.lower().decode()
        return b"".join([self.packed[t.id] for t in self.merges.tokenize(mapped)])

    def _learn(self, word: bytes) -> bytes:
        core = word.rstrip(ENDS)
        if len(core) == len(word):
            ids = self._letters(word)
        elif (ids := self.known.get(core) if core[-1:].isalpha() else None) is None:
            ids = self._letters(core)
        if ids is None or b"<|" in word:
            return self._direct(word)
        return ids if len(core) == len(word) else ids + self._end(word[len(core) :])

    def _end(self, end: bytes) -> bytes:
        ids = self.ends.get(end)
        if ids is None:
            ids = self._direct(end)
            if len(end) <= LONGEST and len(self.ends) < ENDS_REMEMBERED:
                self.ends[end] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text: Arrow tells the words of all texts apart, each different one is looked up once."""
        raw = [text.encode("utf-8", "surrogatepass") for text in texts]
        raw = [r if b"<|" in r else r.lower() for r in raw]  # there, case tells special tokens from text
        lists = pc.ascii_split_whitespace(pa.array(raw, pa.large_binary()).view(pa.large_string()))
        told = lists.flatten().dictionary_encode()  # a text that begins or ends with white space has empty words there
        words = _bytes_of(told.dictionary)
        ids = list(map(self.known.get, words))
        for i in [i for i, own in enumerate(ids) if own is None]:
            ids[i] = self._get(words[i])
        flat, length = np.frombuffer(b"".join(ids), "<u4"), np.array([len(own) // 4 for own in ids], np.int64)
        first, codes = np.cumsum(length) - length, told.indices.to_numpy()
        parts, ends = [], [np.zeros(1, np.int64)]
        for at in range(0, len(codes), WORDS):
            own = codes[at : at + WORDS]
            n = length[own]
            end = np.cumsum(n)
            parts.append(flat[np.repeat(first[own] - end + n, n) + np.arange(end[-1])])
            ends.append(end + ends[-1][-1])
        if not parts:
            return [b""] * len(texts)
        all_ids, bounds = memoryview(np.concatenate(parts)).cast("B"), 4 * np.concatenate(ends)[lists.offsets.to_numpy()]
        return [bytes(all_ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _get(self, word: bytes) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                ids = self._learn(word)
            if len(word) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.older, self.known = self.known, {}
                self.known[word] = ids
        return ids
