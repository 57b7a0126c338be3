"""Near copies against brute force: exact Jaccard components over the sets of five-word shingles."""

import itertools
from collections import defaultdict

import numpy as np
import pytest

from rivulet.llm import fingerprints, simhash


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def groups_of(texts, least=0.8):
    """Least place of the component of each text."""
    sets = [shingles(t) for t in texts]
    root, having = list(range(len(texts))), defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for gram in s or {()}:
            having[gram].append(i)
    for i, j in {p for own in having.values() for p in itertools.combinations(own, 2)}:
        if not sets[i] and not sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-12:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]


def likened(rng, base, likeness):
    """A text whose last words differ from those of base, so that their sets have this likeness (roughly)."""
    n = len(base)
    return base[: round(2 * n * likeness / (1 + likeness))] + words(rng, n - round(2 * n * likeness / (1 + likeness)))


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.fixture(scope="module")
def families():
    """60 families: 38 texts around a shared passage, alike in 0.65, and a pair among them of 0.85 or so."""
    rng, texts = np.random.default_rng(5), []
    for _ in range(60):
        passage = words(rng, 315)
        own = [passage + words(rng, 85) for _ in range(38)]
        a = own[0]
        texts += [" ".join(t) for t in [*own, likened(rng, a, 0.85)]]
    return texts


def test_links_within_families(spark, families):
    """A link is not lost to likelier ones that do not hold, and no text goes for a likeness below the limit."""
    want = groups_of(families)
    assert sum(g != i for i, g in enumerate(want)) == 60
    assert found(spark, families) == want


def test_crowded_family(spark):
    """A band of more than SMALL sets, of which few links hold: the likest first, the others in later rounds."""
    rng, passage = np.random.default_rng(6), words(np.random.default_rng(7), 352)
    own = [passage + words(rng, 48) for _ in range(120)]  # alike in 0.78
    chain = [own[0]]
    for _ in range(6):
        chain.append(likened(rng, chain[-1], 0.82))
    texts = [" ".join(t) for t in [*own, *chain[1:]]]
    want = groups_of(texts)
    assert 1 < len(set(want)) < len(texts)
    assert found(spark, texts) == want


def test_near_groups(spark):
    """All links of the fingerprints, against all pairs."""
    rng, texts = np.random.default_rng(8), []
    for _ in range(12):
        base = " ".join(words(rng, 60))
        texts += [base, *(base[:at] + "##" + base[at:] for at in rng.integers(0, len(base), 6))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    slots, root = fingerprints._slots(texts), list(range(len(texts)))
    bands = slots.reshape(len(texts), -1, fingerprints.BAND)
    for i, j in itertools.combinations(range(len(texts)), 2):
        if (slots[i] == slots[j]).mean() >= 0.8 and (bands[i] == bands[j]).all(axis=1).any():
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert 12 < len(set(root)) < len(texts)
    got = {r["doc_id"]: r["group_id"] for r in fingerprints.near_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_isolated_pairs(spark):
    """Pairs without a third copy, by likeness: all from 0.8 on, none below; short texts too."""
    rng, texts = np.random.default_rng(9), []
    for likeness in (0.7, 0.75, 0.78, 0.81, 0.83, 0.85, 0.9):
        for _ in range(150):
            base = words(rng, 300)
            texts += [" ".join(base), " ".join(likened(rng, base, likeness))]
    for _ in range(150):
        base = words(rng, 9)
        texts += [" ".join(base[:8]), " ".join(base)]  # 4 and 5 shingles, alike in 0.8
    want, got = groups_of(texts), found(spark, texts)
    for k in range(8):
        own = range(300 * k + 1, 300 * k + 300, 2)
        print(k, sum(want[i] != i for i in own), sum(got[i] != i for i in own))
    assert got == want and sum(g != i for i, g in enumerate(want)) >= 600


def test_pipeline_links_by_simhash(spark):
    """Of the pipeline's stage stay what neither links of 3 bits of the fingerprints nor of likeness reach from a lesser identifier."""
    import corpus_pipeline

    rng, texts = np.random.default_rng(10), []
    for _ in range(150):
        base = words(rng, 6)
        texts.append(" ".join(base * 40))
        texts.append(" ".join(base * 41 + words(rng, 150)))  # the repeated shingles decide the bits, not the set
        texts.append(" ".join(words(rng, 30)))
        texts.append(texts[-1] + " more words")
    fps, sets, root = [simhash.simhash(t) for t in texts], groups_of(texts), list(range(len(texts)))
    fps_near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    for i, j in fps_near + list(enumerate(sets)):
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    assert len(set(root)) < min(len(set(sets)), len(texts) - 150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(root)
