"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and gives the columns of documents, the last one the packed pieces. Stages are
written as Parquet and read again by whoever runs them; `run` does so in the shared folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import exact_dedup, language_id, mixing, packing, simhash
from rivulet.llm.queries import MIX_WEIGHTS, source_domain
from rivulet.llm.shared import discard, documents, materialise, new_path, paths, remainder, vocabulary, written

#: The share of the tokens that reach the mixing stage that it keeps.
BUDGET = 0.8
#: A column of the stages' own: the place of a row.
KEY = "__row"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row that orders by identifier (null last), then by the row's place in its file; rows
    that are not those of files are written first."""

    def key(*place: Column) -> Column:
        return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *(p.alias(f"p{i}") for i, p in enumerate(place))).alias(KEY)

    try:
        return docs.select("*", key(F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")))
    except AnalysisException:
        return materialise(docs.select("*", key(F.monotonically_increasing_id())), "keyed")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language go: null texts and those without a letter. Where the language is missing, the predicted
    one is filled in, for mixing; with no label to learn from it stays missing. Each row is judged by itself, whatever
    its identifier."""
    model = language_id.train(docs.where(remainder(5) != 0))
    if model is None:
        return docs.where(language_id.lettered(F.col("text")))
    said = language_id.predict(docs, model).where(F.col("lang_pred") != language_id.UNDETERMINED)
    return said.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: that of the least identifier, the first in its file of rows that share it. Null
    identifiers are greater than others. Null text counts as empty."""
    keyed = _keyed(docs)
    kept = exact_dedup.exact_duplicates(keyed, id_col=KEY, keep="smallest").where("kept").select(KEY)
    return keyed.join(kept, KEY, "left_semi").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, chosen as among equal texts. Near copies are linked by SimHash, all
    links of op7 (three-word shingles, 3 bits of 64 or fewer), and by five-word shingles of likeness 0.8, which
    fingerprints tell apart badly; a group is what links of either kind reach."""
    keyed = _keyed(docs)
    groups = simhash.near_groups(keyed, id_col=KEY, shingle=3, like=5, least=0.8)
    return keyed.join(groups.where(F.col(KEY).eqNullSafe(F.col("component_id"))).select(KEY), KEY, "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to each leaf's budget; one epoch, so each at most once, and whole. Documents without a word are not
    chosen. The seeded order goes by identifier, and by the text's digest for rows without one."""
    keyed = _keyed(docs)
    order = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    chosen = mixing.mix(keyed, BUDGET, MIX_WEIGHTS, source_domain, max_epochs=1, seed=7, id_col=KEY, order_by=order)
    return keyed.join(chosen.select(KEY), KEY, "left_semi").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences, of every row; null text is the end alone."""
    packed = packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=2048, payload=(F.crc32("ids").alias("ids_crc32"),))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Shingle hashes, seeded order and tokens are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way, and the documents it read, go when its result is written."""
    docs, last = documents(spark, sf_dir), ()
    for name, stage in STAGES:
        before, path = paths(), new_path(spark, name)
        docs = written(stage(spark, docs, sf_dir), path)
        discard(*(paths() - before - {path}), *last)
        last = (path,)
    return docs
