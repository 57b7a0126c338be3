"""The registered queries of the corpus operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, filter_audit, fingerprints, language_id, lattice_lm, license_scan, mixing, neighbours, packing, phrases, preferences, simhash, token_counts
from .shared import documents, remainder, vocabulary

#: The mixture: domains by the source's number, twice the weight on the first, and on English within it.
MIX_BUDGET = 0.6
MIX_WEIGHTS = mixing.named_weights([("web", 2.0), ("books", 1.0), ("code", 1.0), ("web/en", 2.0), ("web/en/src0", 0.5)])


def source_domain() -> Column:
    number = F.coalesce(F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1).try_cast("int"), F.lit(0)) % 3
    return F.when(number == 0, "web").when(number == 1, "books").otherwise("code")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), capacity=2048, payload=(F.crc32("ids").alias("ids_crc32"),))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with the last assistant turn of its neighbour, 2k and 2k + 1 being neighbours."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    both = preferences.against_others(turns, F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")))
    return preferences.assemble(preferences.format_preferences(both, F.col("conv_id"), F.col("chosen")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = docs.select("doc_id", license_scan.scan(docs).alias("s"))
    return found.select(
        "doc_id", "s.n_words", "s.n_base", "s.first_word", "s.last_word",
        F.array_join("s.base_labels", ",").alias("base_labels"), F.array_join("s.labels", ",").alias("labels"), "s.score",
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(docs.where(remainder(5) != 0))
    said = language_id.predict(docs.select("doc_id", "text"), model)
    return said.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), MIX_BUDGET, MIX_WEIGHTS, source_domain, max_epochs=2, seed=7)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return fingerprints.edited_fingerprints(documents(spark, sf_dir), ranges)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.exact_groups(documents(spark, sf_dir), shingle=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), limit=4096)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_duplicates(documents(spark, sf_dir), keep="largest")
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lattice_lm.score(documents(spark, sf_dir), remainder(10) != 0, vocabulary("piece_bpe_32k.model"))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir), least=100, top=2000).withColumn("rank", F.col("rank").cast("long"))


def nearest_neighbour_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op12 whatever the order of its sums: who is found, and the cosine to nine digits."""
    return op12_nearest_neighbours(spark, sf_dir).withColumn("score", F.round("score", 9))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op3: words and places of the base phrases, from the same scan."""
    return op3_license_scan(spark, sf_dir).drop("labels", "score")


def edited_text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op6: the edited texts, from the same pairing of documents with the next."""
    return op6_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_license_scan": op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_filter_audit": op11_filter_audit,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_phrase_collocations": op13_phrase_collocations,
    "nearest_neighbour_ids": nearest_neighbour_ids,
    "license_base_places": license_base_places,
    "edited_text_digests": edited_text_digests,
}

ORACLE_SQL = {
    "license_base_places": r"""
        WITH t AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        places AS (
          SELECT doc_id, i, CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache'
                 WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS label
          FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t))
        SELECT t.doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(label) AS n_base, CAST(min(i) - 1 AS BIGINT) AS first_word, CAST(max(i) - 1 AS BIGINT) AS last_word,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
        FROM t LEFT JOIN (SELECT * FROM places WHERE label IS NOT NULL) p ON p.doc_id = t.doc_id GROUP BY t.doc_id""",
    "edited_text_digests": """
        SELECT doc_id, length(body) AS n_chars, sha256(left(body, length(body) - length(body) // 4) || left(other, length(body) // 4)) AS edited_sha256
        FROM (SELECT doc_id, body, coalesce(lead(body) OVER (ORDER BY doc_id), first(body) OVER (ORDER BY doc_id)) AS other
              FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents))""",
    "op2_chat_formatting": """
        WITH plain AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        lasts AS (SELECT conv_id, max({'turn': turn, 'text': text}) AS last FROM plain WHERE role = 'assistant' GROUP BY conv_id),
        swaps AS (SELECT a.conv_id, a.last, b.last.text AS instead FROM lasts a LEFT JOIN lasts b ON b.conv_id = xor(a.conv_id, 1)),
        both_sides AS (
          SELECT conv_id AS pair_id, true AS chosen, turn, role, text FROM plain
          UNION ALL
          SELECT * FROM (
            SELECT p.conv_id, false, p.turn, p.role,
                   CASE WHEN p.role = 'assistant' AND s.last IS NOT NULL AND p.turn = s.last.turn AND p.text = s.last.text THEN s.instead ELSE p.text END AS text
            FROM plain p LEFT JOIN swaps s ON p.conv_id = s.conv_id) WHERE text IS NOT NULL),
        own AS (SELECT *, row_number() OVER (PARTITION BY pair_id, chosen, turn ORDER BY role, text) AS nth FROM both_sides),
        firsts AS (
          SELECT pair_id, min(CASE WHEN differs THEN {'turn': turn, 'nth': nth} END) AS first FROM (
            SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.turn, b.turn) AS turn, coalesce(a.nth, b.nth) AS nth,
                   a.pair_id IS NULL OR b.pair_id IS NULL OR a.role <> b.role OR a.text <> b.text AS differs
            FROM (SELECT * FROM own WHERE chosen) a FULL JOIN (SELECT * FROM own WHERE NOT chosen) b
              ON a.pair_id = b.pair_id AND a.turn = b.turn AND a.nth = b.nth)
          GROUP BY pair_id),
        placed AS (
          SELECT own.*, first IS NULL OR {'turn': turn, 'nth': nth} < first AS shared FROM own JOIN firsts USING (pair_id)),
        parts AS (
          SELECT pair_id, CASE WHEN shared THEN 'prompt' WHEN chosen THEN 'chosen' ELSE 'rejected' END AS part, turn, nth,
                 '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
                 CASE WHEN NOT shared AND role = 'assistant' THEN '1' ELSE '0' END AS loss
          FROM placed WHERE chosen OR NOT shared),
        pieces AS (
          SELECT *, floor(turn / 64) * 2147483648 + (nth - 1) // 64 AS piece FROM parts)
        SELECT pair_id, CAST(piece AS BIGINT) AS piece, CAST(count(*) FILTER (part = 'prompt') AS INTEGER) AS n_prompt,
               coalesce(string_agg(rendered, '' ORDER BY turn, nth) FILTER (part = 'prompt'), '') AS prompt,
               coalesce(string_agg(rendered, '' ORDER BY turn, nth) FILTER (part = 'chosen'), '') AS chosen,
               coalesce(string_agg(rendered, '' ORDER BY turn, nth) FILTER (part = 'rejected'), '') AS rejected,
               coalesce(string_agg(loss || ':' || length(rendered), ',' ORDER BY turn, nth) FILTER (part = 'chosen'), '') AS chosen_mask,
               coalesce(string_agg(loss || ':' || length(rendered), ',' ORDER BY turn, nth) FILTER (part = 'rejected'), '') AS rejected_mask
        FROM pieces GROUP BY pair_id, piece""",
    "op11_filter_audit": r"""
        WITH t AS (
          SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
        f AS (
          SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
                 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
                 'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)} AS x
          FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
        fails AS (
          SELECT part, good, toxic, concat(CASE WHEN x.A THEN 'A' ELSE '' END, CASE WHEN x.B THEN 'B' ELSE '' END, CASE WHEN x.C THEN 'C' ELSE '' END,
                 CASE WHEN x.D THEN 'D' ELSE '' END, CASE WHEN x.E THEN 'E' ELSE '' END) AS failed FROM f),
        sets AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, failed),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
        orders AS (
          SELECT concat(a.c, b.c, c.c, d.c, e.c) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
          WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
        steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
        spots AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[:step - 1] AS before FROM steps),
        met AS (
          SELECT part, filter_order, step, own, n, good, toxic, contains(failed, own) AS fails, failed = own AS only_own,
                 len(regexp_extract_all(failed, '[' || before || '_]')) > 0 AS gone FROM sets, spots)
        SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept,
               CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
               CAST(coalesce(sum(n) FILTER (only_own), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost,
               CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost,
               CAST(sum(coalesce(sum(n) FILTER (fails AND NOT gone), 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM met GROUP BY part, filter_order, step, own""",
    "nearest_neighbour_ids": """
        WITH v AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x) / (sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(c.x, c.x))) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 9) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op13_phrase_collocations": r"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        t AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM t GROUP BY lang),
        starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM t),
        spans AS (SELECT lang, w[i:i + m - 1] AS p FROM (SELECT *, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS m FROM starts)),
        f AS (SELECT lang, p, count(*) AS a FROM spans GROUP BY lang, p HAVING count(*) >= 100),
        cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
        scored AS (
          SELECT c.lang, c.p, c.a, c.k, x.a AS l, y.a AS r, n, CAST(CAST(1000 AS HUGEINT) * c.a * n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
          FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:] JOIN totals ON totals.lang = c.lang),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
        longer AS (SELECT lang, q AS p, max(a) AS more FROM (SELECT lang, a, unnest([p[:-2], p[2:]]) AS q FROM f WHERE len(p) > 2) GROUP BY lang, q),
        kept AS (SELECT best.*, array_to_string(best.p, ' ') AS phrase FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.p = best.p WHERE more IS NULL OR more < best.a)
        SELECT lang, rank, phrase, a, l, r, n, score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
