"""Token counts from a compiled finite-state tokenizer.

A byte-fallback BPE vocabulary with scores is compiled into a deterministic transducer over characters. A state holds
what later merges can depend on: each suffix of the text read so far that begins some piece, the token that ends
where it starts, and its count relative to the count now. A transition is annotated with the tokens it emits (the
count can also fall, where pieces join). States are compiled when they are first needed and kept in a bounded table.

Where two neighbouring characters stand side by side in no piece, nothing merges across, and the state after it does
not depend on what went before: any state that reads a chunk with such a place leaves it alike. So a chunk's state map,
from the state before it to the state after it and the tokens between, is written down whole as its head up to the
first such place (what the state before still has to read), the count from there to the last one, and its tail (what
the state after has read). Long texts are cut into chunks whose maps are made in parallel. `combine` composes two
neighbouring maps, and is associative; the maps of a text are composed as the up-sweep of a prefix scan, FAN neighbours
at a time, level by level in the cluster, as only the whole text's count is asked for.

Null counts as empty: no bytes, no tokens. Repeated rows are counted each; an empty table gives no rows; a null
identifier stays null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

#: States kept before the table starts afresh; characters in a chunk at least, and chunks in a text at most.
MAX_STATES = 200_000
CHUNK, MOST_CHUNKS = 32_768, 64
#: Maps that are composed in one row of a level.
FAN = 8
SPACE = "▁"
#: Below every score.
NONE = float("-inf")
#: Whole stretches kept as edges, and the longest.
MAX_EDGES, LONGEST_EDGE = 250_000, 40
STRETCH = re.compile("[^▁\n]+|▁+[^▁\n]*|\n")


class _State(dict):
    """Transitions by character, compiled when first taken: (next state, tokens emitted)."""

    __slots__ = ("contexts", "machine")

    def __missing__(self, ch: str):
        self[ch] = out = self.machine.step(self.contexts, ch)
        return out


class _Edges(dict):
    """Tokens of stretches from the start state, walked when first asked for; long ones are not kept."""

    __slots__ = ("machine",)

    def __missing__(self, part: str) -> int:
        n = self.machine.walk(part)
        if len(part) <= LONGEST_EDGE:
            if len(self) >= MAX_EDGES:
                self.clear()
            self[part] = n
        return n


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        self.pieces = {p: p for p in self.score}
        self.begins = {b: b for b in {p[:k] for p in self.score for k in range(1, len(p))}}  # to one object each
        self.joined = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.traces: dict[str, tuple] = {}
        self.states: dict[tuple, _State] = {}
        self.edges = _Edges()
        self.edges.machine = self
        # stretches end before a run of spaces and around a line end, if no piece stands across these
        self.plain_cuts = not any("\n" in j or j[1] == SPACE != j[0] for j in self.joined)
        self.start = self.state((("", None, 0),))

    def merges(self, text: str) -> Iterator[tuple[list[str], float]]:
        """The parts of a short string before each of its merges, with the score of that merge, and at the end; the best
        score first, the leftmost of equals."""
        parts, score = list(text), self.score.get
        worth = [score(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while worth and (best := max(worth)) > NONE:
            yield parts, best
            i = worth.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del worth[i]
            if i:
                worth[i - 1] = score(parts[i - 1] + parts[i], NONE)
            if i < len(worth):
                worth[i] = score(parts[i] + parts[i + 1], NONE)
        yield parts, NONE

    def trace(self, piece: str) -> tuple[bool, list[str], list[str], list[float]]:
        """Whether a piece comes out whole, and its first and last part before each of its merges with their scores."""
        own = self.traces.get(piece)
        if own is None:
            steps = [(parts[0], parts[-1], best, len(parts) == 1) for parts, best in self.merges(piece)]
            own = self.traces[piece] = (steps[-1][3], [x[0] for x in steps], [x[1] for x in steps], [x[2] for x in steps])
        return own

    def fits(self, last: str | None, piece: str) -> bool:
        """Whether piece can follow last: neither merges across, nor falls apart. Their merges go on side by side, the
        better one first; across them merges what is better than both next ones, or as good as that on the right."""
        whole, firsts, _, ahead = self.trace(piece)
        if not whole or last is None:
            return whole
        _, _, lasts, before = self.trace(last)
        i = j = 0
        while True:
            s, t = before[i], ahead[j]
            across = self.score.get(lasts[i] + firsts[j], NONE)
            if across > s and across >= t or s == t == NONE:
                return across == NONE
            if s >= t:
                i += 1
            else:
                j += 1

    def state(self, contexts: tuple) -> _State:
        own = self.states.get(contexts)
        if own is None:
            if len(self.states) >= MAX_STATES:
                self.states.clear()
                self.start = _State()
                self.start.contexts, self.start.machine = (("", None, 0),), self
                self.states[self.start.contexts] = self.start
            own = self.states[contexts] = _State()
            own.contexts, own.machine = contexts, self
        return own

    def step(self, contexts: tuple, ch: str):
        """contexts: (suffix, token that ends before it or None if that is free, count there less the count now)."""
        ahead = []
        for s, last, at in contexts:
            free = last is None or not s and last[-1] + ch not in self.joined
            ahead.append((s + ch, None if free else last, at))
        for text, last, at in ahead:
            if text in self.score and self.fits(last, text):
                token, delta = self.pieces[text], at + 1
                break
        else:
            token, delta = ch, ahead[-1][2] + (1 if ch in self.score else len(ch.encode("utf-8", "surrogatepass")))
        kept = [(begin, last, at - delta) for text, last, at in ahead if (begin := self.begins.get(text))]
        return self.state((*kept, ("", token, 0))), delta

    def walk(self, text: str) -> int:
        state, n = self.start, 0
        for ch in text:
            state, delta = state[ch]
            n += delta
        return n

    def count(self, text: str) -> int:
        """Tokens from the start state. A stretch between two places where nothing merges across leads from the start
        state to one that acts like it: once walked, it is kept as one edge with its count."""
        if not self.plain_cuts:
            return self.walk(text)
        return sum(map(self.edges.__getitem__, STRETCH.findall(text)))

    def chunk_map(self, text: str) -> tuple[str, int, str, bool]:
        """(head, count, tail, cut): cut is False where nothing cuts the chunk, which is then all head."""
        joined = self.joined
        first = next((i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joined), 0)
        if not first:
            return text, 0, "", False
        last = next(i for i in range(len(text) - 1, 0, -1) if text[i - 1 : i + 1] not in joined)
        return text[:first], self.count(text[first:last]), text[last:], True

    def combine(self, a: tuple[str, int, str, bool], b: tuple[str, int, str, bool]) -> tuple[str, int, str, bool]:
        """The map of two neighbouring stretches."""
        if not a[3]:
            return a[0] + b[0], b[1], b[2], b[3]
        if not b[3]:
            return a[0], a[1], a[2] + b[0], True
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2], True

    def reduce(self, maps: list[tuple[str, int, str, bool]]) -> tuple[str, int, str, bool]:
        """Neighbours by neighbours, so that a character is copied once a level."""
        while len(maps) > 1:
            maps = [self.combine(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def tokens(self, own: tuple[str, int, str, bool]) -> int:
        """The map of a text taken at the start state."""
        return self.count(own[0]) + own[1] + self.count(own[2])


_MACHINES: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    """One transducer for a worker process."""
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]


MAP = "head string, count long, tail string, cut boolean"


def _composed(model: str):
    """Arrays of a level's neighbouring maps to their map."""

    def run(parts: pd.Series) -> pd.DataFrame:
        own = machine(model)
        rows = [None if p is None else own.reduce([(x["head"], x["count"], x["tail"], x["cut"]) for x in p]) for p in parts]
        return pd.DataFrame([r or (None, None, None, None) for r in rows], columns=["head", "count", "tail", "cut"]).astype({"count": "Int64", "cut": "boolean"})

    run.__annotations__ = {"parts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, MAP)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_bytes, n_tokens, over_limit."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("body"))
    rows = rows.withColumn("n_bytes", F.octet_length("body").cast("long"))
    n = F.char_length("body")
    width = F.greatest(F.lit(CHUNK), F.ceil(n / MOST_CHUNKS)).cast("int")
    whole = F.struct(F.lit(0).alias("chunk"), F.col("body").alias("text"))
    cut = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda i: F.struct(i.alias("chunk"), F.substring(F.col("body"), i * width + 1, width).alias("text")))
    chunks = F.explode(F.when(n <= width, F.array(whole)).otherwise(cut)).alias("c")
    dealt = rows.select("row", "id", "n_bytes", (n <= width).alias("only"), chunks).select("row", "id", "n_bytes", "only", "c.chunk", "c.text")

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = machine(model)
        for b in batches:
            got = []
            for only, chunk, text in zip(b["only"], b["chunk"], b["text"], strict=True):
                marked = text.replace(" ", SPACE)  # what the library reads: spaces as a mark of their own, one before the text
                marked = SPACE + marked if text and not chunk else marked
                got.append(("", own.count(marked), "", True) if only else own.chunk_map(marked))
            yield b.drop(columns=["text", "only"]).assign(**{k: [g[i] for g in got] for i, k in enumerate(("head", "count", "tail", "cut"))})

    level = dealt.mapInPandas(maps, f"row long, id string, n_bytes long, chunk int, {MAP}")
    for k in range(1, round(math.log(MOST_CHUNKS, FAN)) + 1):
        own = F.sort_array(F.collect_list(F.struct("chunk", "head", "count", "tail", "cut")))
        key = F.lit(0) if FAN**k >= MOST_CHUNKS else F.floor(F.col("chunk") / FAN).cast("int")
        held = level.groupBy("row", "id", "n_bytes", key.alias("chunk")).agg(own.alias("parts"))
        held = held.withColumn("m", _composed(model)(F.when(F.size("parts") > 1, F.col("parts"))))
        one = lambda c: F.when(F.size("parts") == 1, F.col("parts")[0][c]).otherwise(F.col(f"m.{c}")).alias(c)  # noqa: B023, E731
        level = held.select("row", "id", "n_bytes", "chunk", *map(one, ("head", "count", "tail", "cut")))

    def ends(head: pd.Series, tail: pd.Series) -> pd.Series:
        own = machine(model)
        return pd.Series([own.count(h) + own.count(t) if h or t else 0 for h, t in zip(head, tail, strict=True)], dtype="int64")

    ends.__annotations__ = {"head": pd.Series, "tail": pd.Series, "return": pd.Series}
    counted = level.select("id", "n_bytes", (F.col("count") + F.pandas_udf(ends, "long")("head", "tail")).alias("n_tokens"))
    return counted.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
