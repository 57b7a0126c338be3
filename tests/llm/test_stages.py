"""Single stages of the pipeline on rows of their own."""

import corpus_pipeline


def test_language_takes_effect(spark):
    texts = {"en": "the cat and the dog went to the house", "fr": "le chat et le chien sont dans la maison"}
    rows = [(i, texts[x], x, "a") for i, x in enumerate(["en", "fr"] * 20)]
    rows += [(100, texts["fr"] + " et le jardin", None, "a"), (101, "12 34", "en", "a"), (102, None, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert len(out) == 41 and out[100] == "fr" and out[0] == "en"
    bare = docs.selectExpr("doc_id", "text", "string(null) as lang", "source")
    kept = corpus_pipeline.identify_language(spark, bare, "").collect()
    assert len(kept) == 41 and {r["lang"] for r in kept} == {None}


def rows_of(spark):
    """Nulls, empty and repeated texts, repeated and null identifiers, columns that clash with the stages' own."""
    long = " ".join(f"word{i}" for i in range(40))
    rows = [
        (1, "a copy of a text", "en", "s0"), (1, "a copy of a text", "en", "s0"), (2, "a copy of a text", None, None), (None, "a copy of a text", "en", "s1"),
        (3, long, "en", "s1"), (3, long + " more", "en", "s1"), (4, "of its own", "fr", None), (4, "a copy of a text", "fr", "s2"),
        (None, None, None, None), (5, "", "en", "s0"), (6, None, "en", "s0"), (None, "no number", "en", "s2"), (7, "A COPY of a text", "en", "s0"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "length(text) as n_chars", "'x' as id", "'x' as digest", "'x' as body", "'x' as node", "1L as n", "'x' as row", "'x' as words")


def texts_of(df):
    return sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())


def test_stages_on_odd_rows(spark):
    docs = rows_of(spark)
    copies = corpus_pipeline.drop_copies(spark, docs, "")
    assert copies.columns == docs.columns
    got = texts_of(copies)
    long = " ".join(f"word{i}" for i in range(40))
    assert got == sorted([("1", "a copy of a text"), ("3", long), ("3", long + " more"), ("4", "of its own"), ("5", ""), ("None", "no number"), ("7", "A COPY of a text")])
    near = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.materialise(copies, "t"), "")  # as the pipeline does, from files
    assert near.columns == docs.columns
    assert [i for i, _ in texts_of(near)] == ["1", "3", "4", "5", "None"]
    mixed = corpus_pipeline.mix_sources(spark, near, "")
    assert mixed.columns == docs.columns and set(texts_of(mixed)) < set(texts_of(near)) and mixed.count() > 0
    packed = corpus_pipeline.pack_sequences(spark, docs, "")
    assert packed.count() == docs.count() and packed.where("doc_id is null").count() == 3
    said = corpus_pipeline.identify_language(spark, docs, "")
    assert said.columns == docs.columns and said.count() == 10
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0, name


def test_mixing_stage_by_brute_force(spark):
    """What stays is each leaf's prefix of the seeded order, by the operator's shares."""
    import hashlib

    from rivulet.llm import mixing, queries

    rows = [(i, " ".join(["w"] * (i % 17 + 1)), ["en", "fr"][i % 2], f"src{i % 5}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    top = {r["source"]: r["d"] for r in docs.select("source", queries.source_domain().alias("d")).distinct().collect()}
    leaves = {}
    for i, text, lang, source in rows:
        leaves.setdefault((top[source], lang, source), []).append((hashlib.md5(f"7-0-{i}".encode()).hexdigest(), i, len(text.split())))
    room = {k: float(sum(n for _, _, n in v)) for k, v in leaves.items()}
    parts = mixing.allot(corpus_pipeline.BUDGET * sum(room.values()), room, queries.MIX_WEIGHTS)
    want = set()
    for k, own in leaves.items():
        left = round(parts[k])
        for _, i, n in sorted(own):
            if left > 0:
                want.add(i)
            left -= n
    assert {r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect()} == want


def test_mixing_holds_one_python_worker_a_task(spark, tmp_path, monkeypatch):
    """Texts go to one Python worker, though rows without a token are filtered out; the quotas to none."""
    from rivulet.llm import mixing

    rows = [(i, "w " * (i % 5), "en", f"src{i % 3}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/docs")
    sized, quotas = [], []
    materialise, select = mixing.materialise, mixing.select_prefixes
    monkeypatch.setattr(mixing, "materialise", lambda df, *a, **b: sized.append(df) or materialise(df, *a, **b))
    monkeypatch.setattr(mixing, "select_prefixes", lambda df, quota, *a: quotas.append(quota) or select(df, quota, *a))
    mixed = corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
    assert 0 < mixed.count() < 48
    assert sized[0]._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert "PythonRDD" not in quotas[0]._jdf.queryExecution().toRdd().toDebugString()
    assert quotas[0].schema.simpleString() == "struct<domain:string,lang:string,source:string,epoch:int,quota:bigint>"


def test_mixing_with_nothing_to_give(spark):
    from rivulet.llm import mixing

    docs = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    assert mixing.mix(docs, 0.5, {("all",): 0.0}).count() == 0
