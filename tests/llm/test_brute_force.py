"""The operators' methods against plain versions of them on small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rivulet.llm import fingerprints, language_id, lattice_lm, license_scan, mixing, simhash
from rivulet.llm.shared import vocabulary

PIECES = vocabulary("piece_bpe_32k.model")


def groups_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def families(rng, n, words, edits):
    """Texts of which some are others with a few words changed."""
    out = []
    for i in range(n):
        if i % 3 and out:
            own = out[int(rng.integers(len(out)))].split()
            for _ in range(int(rng.integers(0, edits))):
                own[int(rng.integers(len(own)))] = f"x{rng.integers(50)}"
        else:
            own = [f"w{x}" for x in rng.integers(0, 400, words)]
        out.append(" ".join(own))
    return out


def plain_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [simhash.ANCHOR_BLOCK, 4])  # 4: all anchors are crowded
def test_simhash_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "ANCHOR_BLOCK", block)
    rng = np.random.default_rng(4)
    texts = [*families(rng, 150, 300, 4), None, "", "  ", "One two", "one TWO", "a\u00c9 b c d", "a\u00e9 b c d"]
    fps = [plain_simhash(t) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert sum(fps[i] != fps[j] for i, j in links) > 20
    want = groups_of(len(texts), links)
    out = {r["doc_id"]: r for r in simhash.exact_groups(frame(spark, texts)).collect()}
    assert [out[i]["fp"] % (1 << 64) for i in range(len(texts))] == fps
    assert [out[i]["component_id"] for i in range(len(texts))] == want


def test_ids_of_other_kinds(spark):
    texts = ["a b c d e f", "a b c d e f", "g", None]
    df = spark.createDataFrame([("x", texts[0]), (None, texts[1]), ("b", texts[2]), (None, texts[3])], "doc_id string, text string")
    for search in (simhash.exact_groups, simhash.similar_groups):
        got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in search(df).collect())
        assert got == [("None", "None"), ("None", "x"), ("b", "b"), ("x", "x")]


def test_mixing_selection(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), ["en", "fr", None][i % 3], ["s1", "s2"][i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = mixing.named_weights([("all/en", 3.0), ("all/fr/s1", 0.0)])
    out = mixing.mix(df, 1500, weights, max_epochs=2, seed=3).collect()
    size = {i: len(t.split()) for i, t, _, _ in rows}
    leaf = {i: ("all", lang or "", source) for i, _, lang, source in rows}
    room = defaultdict(float)
    for i, n in size.items():
        room[leaf[i]] += n
    parts = mixing.allot(1500, {k: 2 * v for k, v in room.items()}, weights)
    want = []
    for k, budget in parts.items():
        left = round(budget)
        for epoch in range(2):
            quota = min(left, int(room[k]))
            left -= quota
            order = sorted((hashlib.md5(f"3-{epoch}-{i}".encode()).hexdigest(), i) for i in size if leaf[i] == k and size[i])
            for _, i in order:
                if quota > 0:
                    want.append((i, epoch, min(quota, size[i])))
                    quota -= size[i]
    assert sorted((r["doc_id"], r["epoch"], r["take_tokens"]) for r in out) == sorted(want)
    assert parts[("all", "fr", "s1")] == 0 and sum(parts.values()) == pytest.approx(1500)


def test_shares_fill_siblings_first():
    rng = np.random.default_rng(9)
    for _ in range(50):
        leaves = {(f"d{a}", f"l{b}", f"s{c}"): float(rng.integers(1, 100)) for a in range(3) for b in range(2) for c in range(2)}
        weights = {("d0",): 2.0, ("d1", "l0"): 3.0, ("d2", "l1", "s0"): 0.5}
        budget = float(rng.integers(1, 900))
        out = mixing.allot(budget, leaves, weights)
        assert sum(out.values()) == pytest.approx(min(budget, sum(leaves.values())))
        assert all(v <= leaves[k] + 1e-9 for k, v in out.items())
        for a, b in combinations(sorted(leaves), 2):  # siblings that are not full have shares by weight
            if a[:2] == b[:2] and out[a] < leaves[a] - 1e-6 and out[b] < leaves[b] - 1e-6:
                assert out[a] / weights.get(a, 1.0) == pytest.approx(out[b] / weights.get(b, 1.0))


def test_language_kernel():
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcde xyzé"), 60)) for _ in range(40)]
    labels = [["p", "q", "r"][i % 3] for i in range(40)]
    present = np.zeros((40, language_id.SLOTS))
    for row, t in zip(present, texts, strict=True):
        clean = re.sub(r"[\x00-`{-\x7f]+", " ", t.lower())
        for n in (1, 2, 3):
            for i in range(len(clean) - n + 1):
                one = language_id.slots_of(clean[i : i + n])
                row[one[-1]] = 1  # the last slot of a gram by itself is its own
        assert set(np.flatnonzero(row)) == set(language_id.slots_of(t).tolist())
    bits = np.packbits(present.astype(np.uint8), axis=1, bitorder="little")
    model = language_id.fit(labels, bits, landmarks=30, ridge=1e-3)
    unit = present / np.sqrt(present.sum(axis=1))[:, None]
    marks = sorted(i for x in "pqr" for i in [j for j in range(40) if labels[j] == x][:10])
    k, kmm = unit @ unit[marks].T, unit[marks] @ unit[marks].T
    y = np.array([[1.0 if own == n else -1.0 for n in "pqr"] for own in labels])
    c = np.diag([sum(1 / labels.count(x) for x in [own]) for own in labels])
    w = np.linalg.solve(k.T @ c @ k + 1e-3 * kmm + 1e-8 * np.eye(30), k.T @ c @ y)
    assert np.allclose(model.score(texts), k @ w, atol=2e-3)


def test_license_places():
    rng = np.random.default_rng(2)
    own = license_scan.Scanner(license_scan.TEMPLATES, license_scan.PHRASES)
    pool = ["mit", "license", "apache", "general", "public", "x", "é", "the", "MIT", "License"]
    for _ in range(300):
        text = "".join(w + rng.choice([" ", ", ", "\n", "-"]) for w in rng.choice(pool, rng.integers(0, 30)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        got = own.scan(text)
        assert (got["n_words"], got["n_base"]) == (len(words), len(places))
        assert got["first_word"] == min((i for i, _ in places), default=None) and got["last_word"] == max((i for i, _ in places), default=None)
        assert got["base_labels"] == sorted({x for _, x in places}) and set(got["base_labels"]) <= set(got["labels"])


def test_license_matches_and_chains():
    rng = np.random.default_rng(7)
    least, gap = 2, 2
    for _ in range(200):
        templates = {n: [" ".join(rng.choice(list("abcdef"), rng.integers(4, 9)))] for n in "xy"}
        own = license_scan.Scanner(templates, {}, least=least, gap=gap, covered=0.5)
        words = rng.choice(list("abcdefz"), 14).tolist()
        seqs = [t[0].split() for t in templates.values()]
        want = []  # stretches of text and template that cannot be prolonged to either side
        for q, t in enumerate(seqs):
            for i in range(len(words)):
                for j in range(len(t)):
                    if words[i] == t[j] and (i == 0 or j == 0 or words[i - 1] != t[j - 1]):
                        n = 0
                        while i + n < len(words) and j + n < len(t) and words[i + n] == t[j + n]:
                            n += 1
                        if n >= least:
                            want.append((i + n, q, j + n, n))
        held = []
        own.chain = lambda matches, held=held: held.extend(matches) or []
        own.scan(" ".join(words))
        assert sorted(held) == sorted(want)
        found = own.chains(held)
        for q in range(2):
            mine = sorted(m for m in want if m[1] == q)
            best = 0
            for k in range(1, len(mine) + 1):
                for chain in combinations(mine, k):
                    covered, ok = chain[0][3], True
                    for (e, _, p, _), (end, _, place, n) in zip(chain, chain[1:], strict=False):
                        shared = max(0, e - (end - n), p - (place - n))
                        ok &= shared < n and e < end and p < place and end - n + shared - e <= gap
                        covered += n - shared
                    best = max(best, covered if ok else 0)
            assert max((c for s, c, _, _ in found if s == q), default=0) == best


def test_license_edited_text():
    own = license_scan.Scanner(license_scan.TEMPLATES, license_scan.PHRASES)
    text = license_scan.TEMPLATES["mit"][1].split()
    text[20] = "SOMETHING"
    del text[60]
    text.insert(100, "extra words")
    got = own.scan("Copyright someone. " + " ".join(text) + " The end.")
    assert "mit" in got["labels"] and 0.9 < got["score"] < 1
    span = max((s for s in got["spans"] if s[0] == "mit"), key=lambda s: s[2] - s[1])
    assert span[1] == 2 and span[2] >= 160


def plain_slots(text):
    """The walk and the sample of each slot, step by step."""
    code, i, j, out = fingerprints._codes(text).tolist(), 0, 0, []
    while i < len(code):
        out.append(code[i])
        i += int(fingerprints._MOVES[j % fingerprints.PERIOD][code[i]])
        j += 1
    mask, slots = (1 << 64) - 1, []
    for m in map(int, fingerprints._MULTIPLIERS):
        def key(at, m=m):
            h = (at + 1) * m & mask
            h ^= h >> 29
            h = h * 0xBF58476D1CE4E5B9 & mask
            return h ^ h >> 32
        if not out:
            slots.append(0)
            continue
        at = min(range(len(out)), key=key)
        h = sum(out[at - k] * int(w) for k, w in enumerate(fingerprints._GRAMS) if at >= k) % (1 << 32)
        slots.append(max(1, (h ^ h >> 15) * 2654435761 % (1 << 32) >> 24))
    return slots


def test_fingerprint_slots():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcé 中z"), n)) for n in (0, 1, 2, 17, 300)]
    assert fingerprints._slots(texts).tolist() == [plain_slots(t) for t in texts]
    near = texts[4][:150] + "Q" + texts[4][150:]
    a, b, c = fingerprints._slots([texts[4], near, "".join(rng.choice(list("mnopq"), 300))])
    assert (a == b).mean() > 0.6 > 0.2 > (a == c).mean()


@pytest.mark.parametrize("block", [fingerprints.BLOCK, 3])
def test_near_groups_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rng = np.random.default_rng(5)
    texts = [None, "", *families(rng, 120, 60, 3)]
    slots = fingerprints._slots([t or "" for t in texts])
    for least in (0.8, 0.6):
        links = [(i, j) for i, j in combinations(range(len(texts)), 2) if (slots[i] == slots[j]).mean() >= least]
        assert sum((slots[i] != slots[j]).any() for i, j in links) > 10
        got = {r["doc_id"]: r["group_id"] for r in fingerprints.near_groups(frame(spark, texts), least).collect()}
        assert [got[i] for i in range(len(texts))] == groups_of(len(texts), links)


def segmentations(text, pieces, longest):
    if not text:
        yield []
    for k in range(1, min(longest, len(text)) + 1):
        if text[:k] in pieces or k == 1:
            for rest in segmentations(text[k:], pieces, longest):
                yield [text[:k], *rest]


def test_lattice_training(spark):
    texts = ["the cat", "the hat the", "été cat", None, "☃ a", "zebra the"]
    own = lattice_lm.lattice(PIECES)
    at = {p: i for i, p in enumerate(own.pieces)}
    fold = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(texts))]
    split = [(t or "").lower().split() for t in texts]
    counts = Counter(w for ws, f in zip(split, fold, strict=True) if f for w in ws)

    def uses(word, logp):
        total, z = Counter(), 0.0
        for parts in segmentations("▁" + word, at, own.longest):
            ids = [(at[p], 1) if p in at else (own.byte, len(p.encode())) for p in parts]
            weight = math.exp(sum(logp[i] * k for i, k in ids))
            z += weight
            for i, k in ids:
                total[i] += weight * k
        return {i: v / z for i, v in total.items()}, z

    words = sorted(counts)
    logp = np.log(own.prior)
    for steps in (1, 2, 3):
        want = np.zeros(len(logp))
        for w in words:
            for i, v in uses(w, logp)[0].items():
                want[i] += v * counts[w]
        assert np.allclose(own.expected([w.encode() for w in words], np.array([counts[w] for w in words], float), logp), want)
        weight = own.prior * lattice_lm.PRIOR + want
        weight[own.end] += sum(fold)
        logp = np.log(weight / weight.sum())
        if steps == 2:
            continue
        told = logp.copy()
        told[own.byte] -= math.log(256)
        train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
        out = {r["doc_id"]: r for r in lattice_lm.score(frame(spark, texts), train, PIECES, steps=steps).collect()}
        for i, ws in enumerate(split):
            score = (sum(math.log(uses(w, told)[1]) for w in ws) + told[own.end]) / math.log(10)
            assert out[i]["score"] == pytest.approx(score, rel=1e-9)
            assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train"]) == (len(ws) + 1, sum(w in counts for w in ws) + 1, fold[i])


def test_words_counted(spark):
    texts = ["", " ", "a", " a  b\t\n c\x0b\x0cd\re ", "é ü x", "\n\n", "中文 字", "a b"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", mixing.tokens(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: len(t.encode().split()) for i, t in enumerate(texts)}
