"""Filter audit, nearest neighbours and phrases against plain versions, and on odd rows."""

from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import filter_audit, neighbours, phrases
from rivulet.llm.perfect_hash import PerfectHash, packed, unpacked

DOCS = "doc_id long, text string, lang string, source string, __file string, word string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


def _audit(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    smallest = {}
    for d, text, *_ in rows:
        if d is not None:
            smallest[text or ""] = min(d, smallest.get(text or "", d))
    failed = defaultdict(list)
    for d, text, _, source in rows:
        text = text or ""
        words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        own = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": d is not None and text in smallest and smallest[text] < d,
        }
        failed[source or ""].append(({k for k, v in own.items() if v}, d in good, d in toxic))
    out = {}
    for part, docs in failed.items():
        shapley = Counter(next(c for c in order if c in f) for order in permutations("ABCDE") for f, *_ in docs if f)
        for order in permutations("ABCDE"):
            for step, own in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [x for x in docs if own in x[0] and not x[0] & before]
                out[part, "".join(order), step] = (
                    sum(not f & (before | {own}) for f, *_ in docs), len(here), sum(own in f and bool(f & before) for f, *_ in docs),
                    sum(f == {own} for f, *_ in docs), sum(g for _, g, _ in here), sum(t for *_, t in here), shapley[own],
                )
    return out


def test_filter_audit_equals_counting_by_order(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, long, "en", "a"), (2, long, "en", "a"), (2, long, "en", "b"), (3, None, None, None), (4, "", "en", ""), (None, long, "en", "a"), (5, "x " * 60, "en", "a"),
        (6, long.upper() + " #", "en", "b"), (7, "\x0b\t a　b \x1c", "en", "b"), (7, "\x0b\t a　b \x1c", "en", "b"), (8, long + " " + "é" * 4000, "en", "a"), (9, "ABC", "en", "a"), (10, None, "en", "a"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (6, None, 1), (9, 1, 1), (None, 1, 1), (77, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(_docs(spark, rows), frame, F.col("source")).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in found} == _audit(rows, labels)
    assert filter_audit.audit(_docs(spark, rows).limit(0), frame, F.col("source")).count() == 0
    texts = filter_audit.audit(_docs(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), frame, F.col("source"))
    assert texts.where("filter_order = 'ABCDE' and step = 1").agg(F.sum(F.col("kept") + F.col("removed"))).first()[0] == len(rows)


def _nearest(ids, vectors, asks, k):
    held = [(i, v) for i, v in zip(ids, vectors, strict=True) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, v) in enumerate(held):
        if i is None or not asks(i):
            continue
        v = np.array(v, np.float64)
        scored = []
        for m, (j, w) in enumerate(held):
            if m != n and len(w) == len(v):
                w = np.array(w, np.float64)
                scored.append((-(v / np.abs(v).max() @ (w / np.abs(w).max())) / np.linalg.norm(v / np.abs(v).max()) / np.linalg.norm(w / np.abs(w).max()), j is None, j))
        scored.sort(key=lambda s: (round(s[0], 12), s[1], s[2] if s[2] is not None else 0))
        out += [(i, rank, j, round(-s, 9)) for rank, (s, _, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def _told(frame):
    return sorted(((r[0], r[1], r[2], round(r[3], 9)) for r in frame.collect()), key=str)


def test_neighbours_equal_all_pairs_at_any_block_size(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(600, 24)).astype(np.float32)
    vectors[100:300] = vectors[7]  # a third of all rows
    vectors[300:320] = vectors[8] * 2
    vectors[400:420] = vectors[9] + rng.normal(scale=1e-4, size=(20, 24)).astype(np.float32)
    data = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, vector string").repartition(5)
    want = _nearest([d[0] for d in data], [d[1] for d in data], lambda i: i % 10 == 0, 5)
    assert _told(neighbours.nearest(frame, F.col("vec_id") % 10 == 0)) == want
    for name, size in (("CANDIDATES", 70), ("QUERIES", 9)):
        monkeypatch.setattr(neighbours, name, size)
    assert _told(neighbours.nearest(frame, F.col("vec_id") % 10 == 0)) == want


def test_search_in_small_tiles_keeps_ties_and_first_places(monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_CANDIDATES", 16)
    monkeypatch.setattr(neighbours, "TILE_QUERIES", 3)
    monkeypatch.setattr(neighbours, "EXACT", 8)
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (300, 20)).astype(np.float64)
    x[:, 0] += 0.5
    found = neighbours.search(x[:40], x, 6)
    norms = np.linalg.norm(x, axis=1)
    for q, heap in enumerate(found):
        cosines = (x[q] * x).sum(axis=1) / (norms[q] * norms)
        want = sorted(range(300), key=lambda m: (-round(float(cosines[m]), 12), m))[:6]
        assert [round(float(cosines[m]), 12) for _, m in sorted(heap, key=lambda h: (-round(h[0], 12), h[1]))] == [round(float(cosines[m]), 12) for m in want]


def test_neighbours_of_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 2.0]), (None, [1.0, 1.0]), (None, None), (100, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]), (7, [None, 1.0]), (150, [1.0, 2.0, 3.0]), (8, [3.0, 2.0, 1.0]), (9, [1e300, 1e300]), (10, [1e-300, 0.0]), (200, [-1e-320, 0.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(frame, F.col("vec_id") % 50 == 0)
    assert _told(found) == _nearest([r[0] for r in rows], [r[1] for r in rows], lambda i: i % 50 == 0, 5)
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.nearest(frame.where("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0
    named = neighbours.nearest(frame.withColumn("vec_id", F.concat(F.lit("v"), "vec_id")), F.col("vec_id") == "v50", k=2)
    assert [(r.query_id, r.rank, r.vec_id) for r in named.orderBy("rank").collect()] == [("v50", 1, "v9"), ("v50", 2, None)]


def _phrases(rows, least, top):
    import re

    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for i in range(len(w)):
                for m in range(1, min(5, len(w) - i) + 1):
                    f[lang or "und"][tuple(w[i : i + m])] += 1
    out = []
    for lang, own in f.items():
        held = {p: a for p, a in own.items() if a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        told = []
        for p, a in held.items():
            if len(p) < 2 or any(len(q) > len(p) and b >= a and inside(p, q) for q, b in held.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            told.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(told)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def _corpus():
    rng = np.random.default_rng(11)
    words = ["red", "Green", "blue", "sky", "é", "d'or", "　x", "a-b", "aa"]
    text = lambda: "".join(rng.choice(words) + str(rng.choice([" ", " ", "  ", "\t", ", ", ".\n"])) for _ in range(int(rng.integers(0, 60))))
    rows = [(i, text(), str(rng.choice(["en", "de"])), "s") for i in range(120)]
    rows += [(200 + i, "the red sky over blue green sea the red sky", "en", "s") for i in range(40)]
    return [*rows, (None, None, None, None), (1, "", "en", None), (2, "aa aa aa aa aa aa", None, "s"), (2, "aa aa aa aa aa aa", "und", "s"), (3, "...", "fr", "s"), (4, "x" * 200_000 + " aa aa", "en", "s")]


@pytest.mark.parametrize("least,top", [(7, 1000), (3, 20), (40, 1000)])
def test_phrases_equal_plain_counting(spark, least, top):
    rows = _corpus()
    docs = _docs(spark, rows).repartition(3)
    want = _phrases(rows, least, top)
    assert want
    assert sorted(tuple(r) for r in phrases.collocations(docs, least, top).collect()) == want
    assert sorted(tuple(r) for r in phrases.by_joins(docs, least, top).collect()) == want


def test_phrases_beyond_the_bound_are_counted_by_joins(spark, monkeypatch):
    docs, calls = _docs(spark, _corpus()), []
    plain = phrases.by_joins
    monkeypatch.setattr(phrases, "by_joins", lambda *a: calls.append(a) or plain(*a))
    want = sorted(tuple(r) for r in phrases.collocations(docs, 3, 50).collect())
    assert sorted(tuple(r) for r in phrases.collocations(docs, 3, 50, most_bytes=10).collect()) == want  # words
    grow = phrases._grow
    monkeypatch.setattr(phrases, "_grow", lambda *a: grow(*a[:-1], 8))  # candidates
    assert sorted(tuple(r) for r in phrases.collocations(docs, 3, 50).collect()) == want
    assert len(calls) == 2
    assert phrases.collocations(docs.limit(0)).count() == phrases.collocations(docs, 10**6).count() == 0


def test_small_runs_and_buckets_change_nothing(spark, monkeypatch):
    docs = _docs(spark, _corpus())
    want = sorted(tuple(r) for r in phrases.collocations(docs, 5, 100).collect())
    for name, value in (("RUN", 50), ("KEYS", 20), ("DISTINCT", 3)):
        monkeypatch.setattr(phrases, name, value)
    assert sorted(tuple(r) for r in phrases.collocations(docs, 5, 100).collect()) == want


def test_perfect_hash_numbers_its_keys_and_no_other():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 100_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        hashed = PerfectHash(keys)
        assert sorted(hashed.slots(keys).tolist()) == list(range(len(keys)))
        others = np.setdiff1d(rng.integers(0, 1 << 63, 1000, dtype=np.uint64), keys)
        assert (hashed.slots(others) == -1).all()
    places = np.unique(rng.integers(0, 1 << 20, 5000))
    counts = rng.integers(1, 1 << 40, len(places))
    rows = [(chunk, *unpacked(data)) for chunk, data in packed(places, counts)]
    assert np.concatenate([c * 65536 + p.astype(np.int64) for c, p, _ in rows]).tolist() == places.tolist()
    assert np.concatenate([n for *_, n in rows]).tolist() == counts.tolist()


def test_phrase_jobs_do_not_grow_with_the_partitions(spark):
    """Sums come to the driver in a number of jobs that the partitions of a shuffle do not change."""
    from rivulet.llm import phrases

    docs = spark.createDataFrame([(i, "a b c d e f g. h i j a b", "en") for i in range(40)], "doc_id long, text string, lang string")
    held, jobs, found = spark.conf.get("spark.sql.shuffle.partitions"), [], []
    try:
        for parts in ("4", "48"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.sparkContext.setJobGroup(f"phrases-{parts}", "")
            found.append(sorted(phrases.collocations(docs, least=20).collect()))
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"phrases-{parts}")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] and len(found[0])
    assert 0 < jobs[1] <= jobs[0] + 40, jobs
