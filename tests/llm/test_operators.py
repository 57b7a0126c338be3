"""The corpus operators against brute force, and on nulls, empty texts, repeats, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import exact_dedup, fingerprints, language_id, lattice_lm, license_scan, mixing, packing, preferences, queries, simhash, token_counts
from rivulet.llm.shared import vocabulary
from rivulet.llm.words import WordIds

BPE, PIECES = vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model")
TEXTS = [
    None, "", "   ", "12 34 --", "Hello world. Hello again, world.", "Hello world. Hello again, world.", "été à l'école\tñandú\n\n中文 字", "x" * 3000,
    "the quick brown fox jumps over the lazy dog " * 900, "Released under the MIT License.", "<|endoftext|> <s> It's we'll", "aa  bb   cc",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, None if i == 4 else f"src{i % 3}", i, i, "z", b"q") for i, t in enumerate(TEXTS)]
    names = "doc_id long, text string, lang string, source string, n_chars long, id long, body string, digest binary"
    return spark.createDataFrame([*rows, rows[4]], names)  # clashing column names, and one row twice


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_exact_dedup(docs, none):
    for digest in (exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 0)):  # the other: all digests clash
        for keep, pick in (("largest", max), ("smallest", min)):
            own = exact_dedup.exact_duplicates(docs, keep=keep, digest=digest).collect()
            assert len(own) == len(TEXTS) + 1
            for r in own:
                same = [i for i, t in [*enumerate(TEXTS), (4, TEXTS[4])] if (t or "") == (TEXTS[r["doc_id"]] or "")]
                assert (r["keep_id"], r["group_size"], r["kept"]) == (pick(same), len(same), r["doc_id"] == pick(same))
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_run_index(docs, tmp_path):
    rows = docs.select(F.col("doc_id").alias("id"), exact_dedup.sha256(F.coalesce("text", F.lit(""))).alias("digest"))
    exact_dedup.flush_runs(rows, 2, str(tmp_path / "runs"))
    runs = exact_dedup.flush_runs(rows.withColumn("id", F.col("id") + 100), 2, str(tmp_path / "runs"))
    found = exact_dedup.lookup(runs, [hashlib.sha256(TEXTS[4].encode()).digest()]).collect()
    assert [(r["low_id"], r["high_id"], r["n"]) for r in found] == [(4, 105, 6)]


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    rows = packing.pack(docs, BPE, capacity=64).collect()
    ids = {}
    for r in rows:
        ids.setdefault((r["sequence_id"]), []).append(r)
    for own in ids.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    for i, text in enumerate(TEXTS):
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        got = b"".join(bytes(r["ids"]) for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"]))
        assert got == want * (1 + (i == 4))
    assert len(ids) <= math.ceil(sum(r["length"] for r in rows) / 64) + 1
    assert packing.pack(none, BPE).count() == 0


def test_fullest_is_best():
    rng = np.random.default_rng(3)
    for _ in range(60):
        left = dict(Counter(rng.integers(1, 30, 7).tolist()))
        room = int(rng.integers(5, 70))
        items = [n for n, k in left.items() for _ in range(k)]
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums}
        chosen = packing.fullest(room, left)
        assert sum(n * k for n, k in chosen) == max(s for s in sums if s <= room)
        assert all(left[n] >= k for n, k in chosen)


def test_license_scan(docs, none):
    out = by_id(docs.select("doc_id", license_scan.scan(docs).alias("s")).select("doc_id", "s.*"))
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, text in enumerate(TEXTS):
        assert out[i]["n_words"] == len(words.findall((text or "").lower()))
    assert (out[9]["n_base"], out[9]["first_word"], out[9]["base_labels"], out[9]["score"]) == (1, 3, ["mit"], 1.0)
    assert out[0]["n_base"] == 0 and out[0]["first_word"] is None and out[0]["labels"] == []
    own = license_scan.Scanner(license_scan.TEMPLATES, license_scan.PHRASES)
    for label, texts in license_scan.TEMPLATES.items():
        for text in texts:
            assert label in own.scan(f"before {text} after")["labels"]
            assert own.scan(text)["score"] == 1.0
    assert own.scan("the MIT x license, an apache, general public mit license")["base_labels"] == ["mit"]
    assert none.select(license_scan.scan(none)).count() == 0


def test_suffix_automaton():
    rng = np.random.default_rng(5)
    seqs = [[bytes([97 + x]) for x in rng.integers(0, 3, rng.integers(1, 9))] for _ in range(6)]
    auto = license_scan.Automaton()
    for i, s in enumerate(seqs):
        auto.add(i, s)
    auto.close()
    for i, s in enumerate(seqs):
        for a in range(len(s)):
            state = 0
            for z in range(a, len(s)):
                state = auto.step[state][s[z]]
                part = s[a : z + 1]
                want = {(k, e) for k, t in enumerate(seqs) for e in range(len(part), len(t) + 1) if t[e - len(part) : e] == part}
                assert auto.ends[state] == want


def test_language_id(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    out = queries.op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    model = language_id.train(docs)
    said = by_id(language_id.predict(docs, model))
    assert all(said[i]["lang_pred"] == "und" and said[i]["score"] == 0 for i in (0, 1, 2, 3))
    assert said[4]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.train(none)).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0


def test_token_counts(docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = by_id(token_counts.count_tokens(docs, PIECES))
    for i, text in enumerate(TEXTS):
        n = len(model.encode(text or ""))
        assert (out[i]["n_bytes"], out[i]["n_tokens"], out[i]["over_limit"]) == (len((text or "").encode()), n, n > 4096)
    assert token_counts.count_tokens(docs, PIECES).count() == len(TEXTS) + 1
    assert token_counts.count_tokens(none, PIECES).count() == 0


def test_chunk_maps_compose():
    import sentencepiece

    model, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.machine(PIECES)
    for text in filter(None, TEXTS):
        marked = "▁" + text[:2000].replace(" ", "▁")
        for k in (1, 3, 50):
            maps = [own.chunk_map(marked[i : i + k]) for i in range(0, len(marked), k)]
            want = len(model.encode(text[:2000]))
            assert own.tokens(own.reduce(maps)) == want
            folded = maps[0]
            for m in maps[1:]:
                folded = own.combine(folded, m)
            assert own.tokens(folded) == want  # associative


def test_fingerprints(docs, none):
    own = docs.dropDuplicates(["doc_id"])
    out = by_id(fingerprints.edited_fingerprints(own, ranges=4))
    for i, text in enumerate(TEXTS):
        text, other = text or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + other[:k]
        assert (out[i]["n_chars"], out[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= out[i]["near_next"] <= 1
    assert out[4]["fingerprint"] == out[5]["fingerprint"] and out[4]["near_next"] == 1
    assert out[8]["near_edited"] > 0.5 > out[8]["near_next"]
    assert fingerprints.edited_fingerprints(none, ranges=4).count() == 0
    groups = by_id(fingerprints.near_groups(docs))
    assert groups[5]["group_id"] == 4 and groups[0]["group_id"] == groups[1]["group_id"] == 0


def test_walks_agree():
    """Side by side, one by one, and on from where the others ended."""
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcé 中"), n)) for n in (1, 5, 80, 400, 9000, *rng.integers(1, 3000, 30))]
    codes = [fingerprints._codes(t) for t in texts]
    together = fingerprints._walk_lanes(codes)
    for c, own in zip(codes, together, strict=True):
        alone = np.zeros(fingerprints.SLOTS, np.uint8)
        fingerprints._walk_on(c.tobytes(), 0, 0, [0, 0, 0], alone)
        assert alone.tolist() == own.tolist()


def test_simhash(docs, none):
    out = by_id(simhash.exact_groups(docs))
    assert out[4]["component_id"] == out[5]["component_id"] == 4
    assert out[0]["fp"] == out[1]["fp"] == out[2]["fp"] == 0 and out[2]["component_id"] == 0
    assert simhash.exact_groups(none).count() == 0 and simhash.similar_groups(none).count() == 0
    assert by_id(simhash.similar_groups(docs))[5]["component_id"] == 4


def test_anchors_cover():
    rng = np.random.default_rng(2)
    window = simhash.Window(0, 0, 32, 31, True)
    a = rng.integers(0, 1 << 32, 300).astype(np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 32, 300).astype(np.uint64))
    (i, x), (j, y) = (simhash.anchors_of(w[:, None], window) for w in (a, b))
    for k in range(300):
        assert x[k] in y[j == k] and y[k] in x[i == k]  # each meets the other at its home


def test_mixing(docs, none):
    assert mixing.share(10, [1, 1, 2], [1, 100, 100]) == [1, 3, 6]
    leaves = {("a", "x", "1"): 5.0, ("a", "x", "2"): 100.0, ("b", "y", "1"): 100.0}
    got = mixing.allot(100, leaves, {("a",): 1.0})
    assert got == {("a", "x", "1"): 5.0, ("a", "x", "2"): 45.0, ("b", "y", "1"): 50.0}
    out = mixing.mix(docs, budget=0.5).collect()
    total = sum(len((t or "").split()) for t in [*TEXTS, TEXTS[4]])
    assert abs(sum(r["take_tokens"] for r in out) - total / 2) <= 3
    twice = mixing.mix(docs, budget=1.5 * total, max_epochs=2)
    assert abs(sum(r["take_tokens"] for r in twice.collect()) - 1.5 * total) <= 3
    assert mixing.mix(none, 0.5).count() == 0


def test_lattice_and_base(docs, none):
    own = lattice_lm.lattice(PIECES)
    logp = np.log(own.prior)
    at = {p: i for i, p in enumerate(own.pieces)}

    def brute(word):
        text = "▁" + word.decode()
        a = [0.0] + [-math.inf] * len(text)
        for z in range(1, len(text) + 1):
            for s in range(max(0, z - own.longest), z):
                part = text[s:z]
                if part in at:
                    a[z] = np.logaddexp(a[z], a[s] + logp[at[part]])
                elif len(part) == 1:
                    a[z] = np.logaddexp(a[z], a[s] + logp[own.byte] * len(part.encode()))
        return a[-1] / math.log(10)

    words = ["hello".encode(), "été".encode(), "中文a".encode(), b"a", b"internationalisation", "☃".encode()]
    assert np.allclose(own.log10(words, logp), [brute(w) for w in words])
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    out = lattice_lm.score(docs, train, PIECES).collect()
    rows = [*enumerate(TEXTS), (4, TEXTS[4])]
    split = [(i, (t or "").encode().lower().split()) for i, t in rows]
    c = Counter(w for i, ws in split if zlib.crc32(str(i).encode()) % 10 for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    base = {i: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, None]) for i, ws in split}
    assert len(out) == len(rows)
    for r in out:
        assert math.isclose(r["base_score"], base[r["doc_id"]], rel_tol=1e-9) and r["train_tokens"] == n and r["score"] < 0
    assert lattice_lm.score(none, train, PIECES).count() == 0


def test_preferences(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, None, None), (None, 0, "user", "lost"),
        (4, 0, "user", "same"), (4, 1, "user", "b"), (4, 1, "user", "b"), (4, 1, "assistant", "a"), (5, 0, "user", "same"), (5, 1, "user", "b"), (5, 1, "assistant", "a"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit("z"))
    rows = preferences.format_preferences(df, F.floor(F.col("conv_id") / 2).cast("long"), F.pmod("conv_id", F.lit(2)) == 0)
    got = sorted((r["pair_id"], r["part"], r["turn"], r["nth"], r["loss"]) for r in rows.collect())
    assert got == [
        (0, "chosen", 1, 1, 1), (0, "prompt", 0, 1, 0), (0, "rejected", 1, 1, 1), (1, "chosen", 0, 1, 0),
        (2, "chosen", 1, 3, 0), (2, "prompt", 0, 1, 0), (2, "prompt", 1, 1, 0), (2, "prompt", 1, 2, 0),  # repeated turn numbers
    ]
    whole = {r["pair_id"]: r for r in preferences.assemble(rows).collect()}
    assert whole[0]["prompt"] == "<|user|>\nhi<|end|>\n" and whole[0]["chosen_mask"] == "1:25" and whole[1]["rejected"] == "" and whole[2]["n_prompt"] == 3
    assert preferences.format_preferences(df.where("false"), F.col("conv_id"), F.lit(True)).count() == 0


def test_pairs_against_others(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}-{t}") for c in range(3) for t in range(4)] + [(3, 0, "user", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    both = preferences.against_others(df, F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")))
    formatted = preferences.format_preferences(both, F.col("conv_id"), F.col("chosen"))
    out = {r["pair_id"]: r for r in preferences.assemble(formatted).collect()}
    say = lambda c, t: f"<|{'user' if t % 2 == 0 else 'assistant'}|>\n{c}-{t}<|end|>\n"
    for c, other in ((0, 1), (1, 0)):
        assert out[c]["prompt"] == "".join(say(c, t) for t in range(3))
        assert (out[c]["chosen"], out[c]["rejected"]) == (say(c, 3), say(other, 3)) and out[c]["rejected_mask"] == f"1:{len(say(c, 3))}"
    assert out[2]["chosen"] == say(2, 3) and out[2]["rejected"] == ""  # its neighbour says nothing
    assert out[3]["n_prompt"] == 1 and out[3]["chosen"] == out[3]["rejected"] == ""
    long = spark.range(1000).select(F.lit(0).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    pieces = preferences.assemble(preferences.format_preferences(long, F.col("conv_id"), F.lit(True))).orderBy("piece").collect()
    assert len(pieces) == 16 and "".join(r["chosen"] for r in pieces) == "".join(f"<|user|>\n{i}<|end|>\n" for i in range(1000))


def test_word_ids_are_those_of_the_library():
    """Whole texts at once: white space at either end, empty texts, special tokens, ends of any punctuation; and plain words
    with such ends are learned from their letters, not by the library's whole encoding."""
    from tokenizers import Tokenizer

    path = BPE
    library = Tokenizer.from_file(path)
    plain = "haanth. Haanth.. haanth*** nden,&&& ciónbo.%%% ÉIER!! ñezie$$$ haanth' haanth-_-"
    odd = "a<|endoftext a<|endoftext|>! A<|B. <|endoftext|>. it's it's' x's. 1. a1*** a\x1cb ñ** İ. ß! ſ.. ʼn! ... * a<| 'S' don't'"
    texts = [plain, "", " \n", odd, f"\t{plain} {odd}\r\n", "x" * 300 + " y", "　a \x85b", odd.upper()]
    words = WordIds(path)
    direct, whole = [], words._direct
    words._direct = lambda word: direct.append(word) or whole(word)
    assert np.frombuffer(words.encode([plain])[0], "<u4").tolist() == library.encode(plain, add_special_tokens=False).ids
    assert not [word for word in direct if any(c.isalpha() for c in word.decode())]
    for _ in range(2):
        assert [np.frombuffer(own, "<u4").tolist() for own in words.encode(texts)] == [library.encode(text, add_special_tokens=False).ids for text in texts]
    assert words.encode([]) == [] and [list(range(*s.indices(4))) for s in packing.blocks(["a", "b" * (packing.BLOCK + 1), "", "c"])] == [[0], [1], [2, 3]]
