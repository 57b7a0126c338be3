"""Phrases of two to five words that stand together more often than their parts explain.

Words are counted language by language; a word that is frequent in a language gets a number, and texts are written once
as those numbers, broken where a piece ends, a word is rare or the language changes. Then, length by length: a phrase
is safe by the Apriori rule if both phrases one word shorter in it are frequent, and its key is exact: the slot of the
shorter one it begins with, and the number of its last word. Mappers count keys in hashed buckets (numpy), whose sums
leave the keys that may be frequent; the distinct ones are candidates. A minimal perfect hash numbers them; mappers
look keys up, compare the stored key, and bincount slots; the arrays are summed as a tree. Frequent phrases keep a
hash of their own, by whose slots every cut of a phrase is read: its beginnings by following its key, its endings
by looking up the keys without the first word.

Buckets only rule out what cannot be frequent, so counts are exact. Hash tables are broadcast behind a check of their
size; where frequent words or candidates are beyond it (MOST_BYTES), phrases are counted and cut by joins instead
(`by_joins`), with the same result.

Null text counts as empty, a null language as `und`. Repeated rows count each time. Further columns are ignored; an
empty table gives no rows, and so does one in which no phrase is frequent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .perfect_hash import CHUNK, COUNTS, PerfectHash, mixed, packed, tree_sum, unpacked
from .shared import materialise, text_or_empty

LONGEST = 5
#: Bytes of frequent words, and of the keys of one length, that are broadcast.
MOST_BYTES = 256_000_000
#: Words remembered before a mapper sends its counts, bytes of text split at a time, numbers in a written row, keys sorted at a time.
DISTINCT, TEXT, RUN, KEYS = 500_000, 1 << 22, 1 << 20, 1 << 21
#: Parts in which sums come to the driver: each is a job, so they do not grow with the partitions of a shuffle.
SENT = 8
#: Buckets: so many occurrences each, in powers of two, from a chunk of counts to 128 MB of bits.
LOAD, MOST_BUCKETS = 4, 1 << 30

_UPPER, _ENDS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\n\x0b\x0c\r"
#: A-Z to lower case, ends of pieces to line ends, tabs to spaces.
_PLAIN = bytes.maketrans(_UPPER + _ENDS + b"\t", _UPPER.lower() + b"\n" * len(_ENDS) + b" ")
#: Stands for the end of a piece among words, none of which holds it.
_END = b"."


def _words(texts: list[bytes]) -> list[bytes]:
    """Words of texts, an _END after each piece."""
    return b"\n".join([t.translate(_PLAIN) for t in texts]).replace(b"\n", b" . ").split()


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        size = 0
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            texts.setdefault(lang, []).append(text.as_py())
            size += len(texts[lang][-1])
            if size > TEXT:
                for known, own in texts.items():
                    yield known, _words(own)
                texts, size = {}, 0
        for lang, own in texts.items():
            yield lang, _words(own)


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).cast("binary").alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n); word as bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                own.pop(_END, None)
                for word in [w for w in own if len(w) > CHUNK]:  # each in a batch of its own
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "word": [word], "n": [own.pop(word)]})
                words, n = list(own), list(own.values())
                for at in range(0, len(words), CHUNK):
                    end = at + CHUNK
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(words[at:end]), "word": words[at:end], "n": n[at:end]})
            counts.clear()

        for lang, words in _by_language(batches):
            counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > DISTINCT:
                yield from told()
        yield from told()

    return texts.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class _Table:
    """Frequent phrases of one length by slot: their keys and counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.hash = PerfectHash(keys)
        self.counts = np.empty(len(keys), np.int64)
        self.counts[self.hash.slots(keys)] = counts


class _Known:
    """What mappers are sent: frequent words by number, with their language and count, and tables from length 2 on."""

    def __init__(self, langs: list[str], words: list[bytes], counts: list[int]):
        self.langs, self.words, self.counts, self.tables = langs, words, np.array(counts, np.int64), []

    def safe(self, numbers: np.ndarray) -> np.ndarray:
        """Keys of the places at which a phrase one word longer than the tables may be frequent."""
        at = np.flatnonzero(numbers >= 0)
        slots = numbers[at]
        for length in range(2, len(self.tables) + 3):
            next_too = np.flatnonzero(at[1:] == at[:-1] + 1)
            at, prefix = at[next_too], slots[next_too]
            keys = prefix.astype(np.uint64) << np.uint64(32) | numbers[at + length - 1].astype(np.uint64)
            if length == len(self.tables) + 2:
                return keys
            slots = self.tables[length - 2].hash.slots(keys)
            at, slots = at[slots >= 0], slots[slots >= 0]
        return keys

    def count(self, length: int, slots: np.ndarray) -> np.ndarray:
        return self.counts[slots] if length == 1 else self.tables[length - 2].counts[slots]

    def split(self, length: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The phrase without its last word, and its last word."""
        keys = self.tables[length - 2].hash.keys[slots]
        return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def ending(self, length: int, slots: np.ndarray) -> np.ndarray:
        """The phrase without its first word."""
        begin, last = self.split(length, slots)
        if length == 2:
            return last
        keys = self.ending(length - 1, begin).astype(np.uint64) << np.uint64(32) | last.astype(np.uint64)
        return self.tables[length - 3].hash.slots(keys)

    def spelled(self, length: int, slots: np.ndarray) -> np.ndarray:
        """Numbers of the words, a column each."""
        columns = []
        while length > 1:
            slots, last = self.split(length, slots)
            columns.append(last)
            length -= 1
        return np.stack([slots, *columns[::-1]], axis=1)


def _numbered(texts: DataFrame, known) -> DataFrame:
    """Texts as runs of the numbers of frequent words, -1 between what does not stand together; 32 bits each."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, dict[bytes, int]] = {}
        for n, (lang, word) in enumerate(zip(known.value.langs, known.value.words, strict=True)):
            numbers.setdefault(lang, {})[word] = n
        held, size = [], 0

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"numbers": pa.array([np.concatenate(held).tobytes()], pa.binary())})

        for lang, words in _by_language(batches):
            if lang in numbers:
                own = np.fromiter(map(numbers[lang].get, words, repeat(-1)), np.int32, len(words))
                kept = own >= 0
                kept[1:] |= kept[:-1]  # of stretches without a frequent word, one place
                held += [own[kept], np.array([-1], np.int32)]
                size += int(kept.sum()) + 1
            if size > RUN:
                yield written()
                held, size = [], 0
        if held:
            yield written()

    return texts.mapInArrow(number, "numbers binary")


def _keys(batches: Iterator[pa.RecordBatch], known: _Known, passing=None) -> Iterator[np.ndarray]:
    """Safe keys of the runs, about KEYS at a time."""
    held, size = [], 0
    for batch in batches:
        for run in batch["numbers"]:
            keys = known.safe(np.frombuffer(run.as_buffer(), np.int32))
            keys = keys if passing is None else keys[passing(keys)]
            held.append(keys)
            size += len(keys)
            if size > KEYS:
                yield np.concatenate(held)
                held, size = [], 0
    if size:
        yield np.concatenate(held)


def _rows(places: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for chunk, data in packed(places, counts):
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "data": pa.array([data], pa.binary())})


def _sent(rows: DataFrame) -> Iterator:
    """Rows, made side by side in one job; SENT parts of them come to the driver one after the other."""
    return materialise(rows, "sums").coalesce(SENT).toLocalIterator()


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys, 77) & np.uint64(buckets - 1)).astype(np.int64)


def _bucket_bits(runs: DataFrame, known, buckets: int, least: int) -> np.ndarray:
    """A bit a bucket: whether `least` or more safe keys fell there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in _keys(batches, known.value):
            at, n = np.unique(_bucket(keys, buckets), return_counts=True)
            yield from _rows(at, n)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch["chunk"].to_pylist(), batch["data"].to_pylist(), strict=True):
                places, n = unpacked(data)
                full = np.zeros(CHUNK, bool)
                full[places] = n >= least
                if full.any():
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "data": pa.array([np.packbits(full).tobytes()], pa.binary())})

    out = np.zeros(buckets // 8, np.uint8)
    for row in _sent(tree_sum(runs.mapInArrow(count, COUNTS)).mapInArrow(bits, COUNTS)):  # buckets / 8 bytes at most
        out[row["chunk"] * (CHUNK // 8) : (row["chunk"] + 1) * (CHUNK // 8)] = np.frombuffer(row["data"], np.uint8)
    return out


def _candidates(runs: DataFrame, known, bits, buckets: int) -> DataFrame:
    """(key): distinct safe keys whose bucket is full. Mappers send theirs packed, a row a shard, and shards merge them."""
    shards = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = bits.value

        def passing(keys: np.ndarray) -> np.ndarray:
            at = _bucket(keys, buckets)
            return (full[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

        for keys in _keys(batches, known.value, passing):
            keys = np.unique(keys)
            shard = (mixed(keys, 78) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            own, starts = np.unique(shard[order], return_index=True)
            for chunk, part in zip(own.tolist(), np.split(keys[order], starts[1:]), strict=True):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "data": pa.array([part.tobytes()], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([np.frombuffer(data.as_buffer(), np.uint64) for data in table["data"]]))
        return pa.table({"key": keys.view(np.int64)})

    return runs.mapInArrow(collect, COUNTS).groupBy("chunk").applyInArrow(merge, "key long")


def _counted(runs: DataFrame, known, hashed, n: int) -> np.ndarray:
    """Occurrences of each candidate by slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for keys in _keys(batches, known.value):
            slots = hashed.value.slots(keys)
            total += np.bincount(slots[slots >= 0], minlength=n)
        at = np.flatnonzero(total)
        yield from _rows(at, total[at])

    out = np.zeros(n, np.int64)
    for row in _sent(tree_sum(runs.mapInArrow(count, COUNTS))):  # n is bounded by MOST_BYTES
        places, counts = unpacked(row["data"])
        out[row["chunk"] * CHUNK + places.astype(np.int64)] = counts
    return out


def _grow(spark: SparkSession, runs: DataFrame, known: _Known, least: int, occurrences: int, most_bytes: int) -> bool:
    """Adds the table of phrases one word longer; False if their candidates are beyond `most_bytes`."""
    sent = spark.sparkContext.broadcast(known)
    held = [sent]
    try:
        buckets = min(MOST_BUCKETS, max(CHUNK, 1 << (occurrences // LOAD).bit_length()))
        bits = spark.sparkContext.broadcast(_bucket_bits(runs, sent, buckets, least))
        held.append(bits)
        keys = materialise(_candidates(runs, sent, bits, buckets), "candidates")
        n = keys.count()
        if 8 * n > most_bytes:
            return False
        if not n:
            known.tables.append(_Table(np.empty(0, np.uint64), np.empty(0, np.int64)))
            return True
        hashed = PerfectHash(keys.toArrow()["key"].to_numpy().view(np.uint64))  # behind the check above
        held.append(spark.sparkContext.broadcast(hashed))
        counts = _counted(runs, sent, held[-1], n)
        known.tables.append(_Table(hashed.keys[counts >= least], counts[counts >= least]))
        return True
    finally:
        for b in held:
            b.unpersist()


def _cut(known, totals: dict[str, int], frequent: list[int]):
    """Rows (id) of the phrases of length 2 on, numbered through the tables, to their best cuts."""
    starts = np.cumsum([0, *frequent])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = known.value
        for batch in batches:
            ids = batch["id"].to_numpy()
            for length in range(2, LONGEST + 1):
                slots = ids[(ids >= starts[length - 2]) & (ids < starts[length - 1])] - starts[length - 2]
                if not len(slots):
                    continue
                a, spelled = k.count(length, slots), k.spelled(length, slots)
                first, rest = [None] * length, [None] * length  # by the words of the first part
                begin, end = slots, slots
                for words in range(length - 1, 0, -1):
                    begin = k.split(words + 1, begin)[0]
                    end = k.ending(words + 1, end)
                    first[words], rest[length - words] = k.count(words, begin), k.count(words, end)
                langs = [k.langs[w] for w in spelled[:, 0].tolist()]
                out = {c: [] for c in ("l", "r", "n", "score")}
                for i, lang in enumerate(langs):
                    n, own = totals[lang], int(a[i])
                    cuts = [(1000 * own * n // (int(first[w][i]) * int(rest[w][i])), w) for w in range(1, length)]
                    score, w = min(cuts)
                    for c, v in zip(("l", "r", "n", "score"), (int(first[w][i]), int(rest[w][i]), n, score), strict=True):
                        out[c].append(v)
                shorter = [k.split(length, slots)[0], k.ending(length, slots)]
                same = [np.where(k.count(length - 1, s) <= a, s + (starts[length - 3] if length > 2 else 0), -1) for s in shorter]
                if length == 2:
                    same = [np.full(len(slots), -1)] * 2  # single words are no candidates
                phrase = [b" ".join([k.words[w] for w in row]).decode("utf-8", "surrogatepass") for row in spelled.tolist()]
                yield pa.RecordBatch.from_pydict(
                    {"id": slots + starts[length - 2], "lang": langs, "phrase": phrase, "a": a} | {c: pa.array(v, pa.int64()) for c, v in out.items()} | {"within": pa.array(np.stack(same, 1).tolist(), pa.list_(pa.int64()))}
                )

    return cut


def _ranked(phrases: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language. `least`: occurrences of a
    frequent phrase, 1 or more."""
    spark = docs.sparkSession
    texts = _texts(docs, lang_col, text_col)
    counts = materialise(word_counts(texts), "words")
    frequent = counts.where(F.col("n") >= least)
    occurrences, size = frequent.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.octet_length("word") + 60), F.lit(0))).first()
    if size > most_bytes:
        return by_joins(docs, least, top, lang_col, text_col)
    words = frequent.join(counts.groupBy("lang").agg(F.sum("n").alias("all")), "lang").orderBy("lang", "word").toArrow()  # behind the check above
    known = _Known(words["lang"].to_pylist(), words["word"].to_pylist(), words["n"].to_pylist())
    totals = dict(zip(known.langs, words["all"].to_pylist(), strict=True))
    sent = spark.sparkContext.broadcast(known)
    runs = materialise(_numbered(texts, sent), "numbers", compression="zstd")
    sent.unpersist()
    for _ in range(2, LONGEST + 1):
        if not _grow(spark, runs, known, least, occurrences, most_bytes):
            return by_joins(docs, least, top, lang_col, text_col)
        occurrences = int(known.tables[-1].counts.sum())
    sizes = [len(t.counts) for t in known.tables]
    ids = spark.range(0, sum(sizes), 1, max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(sizes) // 1000)))
    phrases = ids.mapInArrow(
        _cut(spark.sparkContext.broadcast(known), totals, sizes), "id long, lang string, phrase string, a long, l long, r long, n long, score long, within array<long>"
    )
    phrases = materialise(phrases, "phrases")
    within = phrases.select(F.explode("within").alias("id")).where("id >= 0").distinct()
    return _ranked(phrases.join(within, "id", "left_anti"), top)


def by_joins(docs: DataFrame, least: int, top: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The same by DataFrame operations: every phrase is shuffled, whatever its number."""
    lower = F.translate(text_or_empty(text_col), _UPPER.decode(), _UPPER.lower().decode())
    pieces = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(lower, "[.,;:!?\\x0A-\\x0D]")).alias("piece"))
    words = pieces.select("lang", F.filter(F.split("piece", "[\\x20\\x09]+"), lambda w: w != "").alias("w")).where("size(w) > 0")

    def starting(i: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size("w") - i)), lambda m: F.slice("w", i + 1, m))

    phrases = words.select("lang", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 1), starting))).alias("p"))
    counts = materialise(phrases.groupBy("lang", "p").agg(F.count(F.lit(1)).alias("a")).where(F.col("a") >= least), "phrases")
    totals = words.groupBy("lang").agg(F.sum(F.size("w")).cast("long").alias("n"))
    own = counts.where("size(p) > 1")
    cuts = own.select("*", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.withColumns({"p1": F.slice("p", F.lit(1), F.col("k")), "p2": F.slice("p", F.col("k") + 1, F.size("p"))})
    part = lambda p, f: counts.select("lang", F.col("p").alias(p), F.col("a").alias(f))
    met = cuts.join(part("p1", "l"), ["lang", "p1"]).join(part("p2", "r"), ["lang", "p2"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    met = met.withColumn("score", F.call_function("div", 1000 * wide("a") * wide("n"), wide("l") * wide("r")).cast("long"))
    best = met.groupBy("lang", "p").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "p", "x.*")
    longer = own.where("size(p) > 2").select("lang", "a", F.explode(F.array(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p")))).alias("p"))
    kept = best.join(longer.groupBy("lang", "p").agg(F.max("a").alias("more")), ["lang", "p"], "left").where("more is null or more < a")
    return _ranked(kept.withColumn("phrase", F.array_join("p", " ")), top)
