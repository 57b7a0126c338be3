"""Identifiers of any kind: the next document, and sets of shingles that share a digest."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import fingerprints, language_id, simhash


def _edited(rows):
    """Rows in files of one each are in the order of writing; here texts are distinct, so pairs are told by them."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0))
    out = {}
    for i, (_, text) in enumerate(ordered):
        text, other = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(text) // 4
        out[text] = hashlib.sha256((text[: len(text) - cut] + other[:cut]).encode()).hexdigest()
    return out


@pytest.mark.parametrize("ranges", [1, 7])
@pytest.mark.parametrize("kind,ids", [("long", [None, 1, 2, 3]), ("long", [5, -3, None, 10**12, 7]), ("string", ["b", "a", None, "ab", "Z"]), ("double", [0.5, None, -1.25, 1e300])])
def test_next_document_of_any_identifier(spark, kind, ids, ranges):
    rows = [(i, f"text {n} " + "abcdefgh" * (n + 1)) for n, i in enumerate(ids)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], f"doc_id {kind}, text string, __file int").repartition(2)
    found = fingerprints.edited_fingerprints(docs, ranges).join(docs.select(F.col("doc_id").alias("i"), "text"), F.col("i").eqNullSafe(F.col("doc_id"))).collect()
    assert {r["text"]: r["edited_sha256"] for r in found} == _edited(rows)


def test_rows_that_share_an_identifier_or_have_none_form_one_circle(spark):
    rows = [(None, f"n{k} " + "x" * 40 + str(k)) for k in range(30)] + [(4, f"f{k} " + "y" * 40 + str(k)) for k in range(30)] + [(9, "last " + "z" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for own in (docs, docs.where("doc_id is null")):
        texts = [r["text"] for r in own.collect()]
        cut = {t: len(t) // 4 for t in texts}
        made = {hashlib.sha256((t[: len(t) - cut[t]] + o[: cut[t]]).encode()).hexdigest(): (t, o) for t in texts for o in texts}
        found = fingerprints.edited_fingerprints(own, 9).collect()
        pairs = [made[r["edited_sha256"]] for r in found]
        assert len(found) == len(texts) and sorted(a for a, _ in pairs) == sorted(b for _, b in pairs) == sorted(texts)
        step, at, seen = dict(pairs), texts[0], set()
        while at not in seen:
            seen.add(at)
            at = step[at]
        assert len(seen) == len(texts)


def test_sets_that_share_a_digest_are_told_apart(spark, monkeypatch):
    texts = [" ".join(f"{a}{i}" for i in range(40)) for a in "abcdefgh"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0], texts[3]])], "doc_id long, text string")
    plain = simhash._signatures
    weak = lambda *a: plain(*a).withField("node", F.lit(7).cast("long"))
    monkeypatch.setattr(simhash, "_signatures", weak)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert found == {**{i: i for i in range(8)}, 8: 0, 9: 3}
    assert np.unique(list(found.values())).size == 8


def test_sample_of_one_identifier(spark):
    """A third of all rows share an identifier and a text, another third an identifier alone: the sample is cut in Spark,
    and rows of one identifier are drawn one by one."""
    rows = [("x", "same words", "a")] * 400 + [("x", f"text {chr(97 + i % 26) * 3}{chr(97 + i // 26) * 2}", "b") for i in range(400)] + [(str(i), f"other {i}", "c") for i in range(400)] + [(None, "z", "d")]
    df = spark.createDataFrame(rows, "id string, body string, label string")
    labels, bits = language_id.sample(df, 50, 8, 3, 11)
    counts = Counter(labels)
    assert 35 < counts["b"] <= 50 and 35 < counts["c"] <= 50 and counts["d"] == 1 and counts["a"] in (0, 50)  # the draw is a hash
    assert len(bits) == len(labels) and len({b.tobytes() for b, k in zip(bits, labels, strict=True) if k == "b"}) > 10
    again, same = language_id.sample(df.repartition(5), 50, 8, 3, 11)
    assert labels == again and (bits == same).all()
