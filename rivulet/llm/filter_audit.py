"""How filters of a corpus interact: what each removes in every order of them, from one relational pass.

Words are exploded and aggregated by (document, word), then by document, to totals and distinct words. The flags of
the other filters are outer-joined: characters and symbols of the text, copies by the merge index of exact dedup,
labels. Which of five filters a document fails is one of 32 patterns; each part of the corpus becomes one row of 32
conditional counts (and as many of good and of toxic documents), from which all 120 orders follow by arithmetic.

Failure: A under 50 words; B 100 x distinct words under 65 x words; C 100 x capitals A-Z over 5 x characters; D holds
any of #$%&*|; E equal to the text of a document of smaller identifier. Words are maximal runs without blanks
(space and the five control characters from tab on), case kept.

Null text counts as empty, a null part as the empty string. Rows of one identifier are documents each; a row without
an identifier has no smaller one and no labels, and is no other's smaller one. A document is good (toxic) if any of its
label rows says so. Further columns are ignored; an empty table has no parts and so no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exact_dedup
from .shared import FILE, ROW, placed, text_or_empty

FILTERS = "ABCDE"
PATTERNS = 1 << len(FILTERS)
ORDERS = len(list(permutations(FILTERS)))


def word_totals(texts: DataFrame, key: tuple[str, ...], text: str = "text") -> DataFrame:
    """(key, words, distinct): of each text with a word. Texts are dealt by the key once; both aggregations happen where
    they then lie, so no word is shuffled."""
    words = texts.repartition(*key).select(*key, F.explode(F.split(text, "[\\x20\\x09-\\x0D]+")).alias("word")).where("word <> ''")
    counted = words.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*key).agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct"))


def patterns(docs: DataFrame, labels: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, pattern, good, toxic), a row a document; bit i of the pattern is set if the document fails filter i."""
    rows = placed(docs, F.col(id_col).alias("id"), part.alias("part"), text_or_empty(text_col).alias("text"))
    place = (FILE, ROW)
    counted = word_totals(rows.select(*place, "text"), place)
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    own = rows.select(
        *place, "id", F.coalesce("part", F.lit("")).alias("part"),
        (100 * capitals.cast("long") > 5 * F.char_length("text").cast("long")).alias("c"), F.col("text").rlike("[#$%&*|]").alias("d"),
    )
    ordered = rows.select(F.struct(F.col("id").isNull().alias("none"), "id", *place).alias("at"), "text")
    same = exact_dedup.exact_duplicates(ordered, id_col="at", text_col="text", keep="smallest")
    copies = same.where(F.col("keep_id.id") < F.col("at.id")).select(*(F.col(f"at.{c}").alias(c) for c in place), F.lit(True).alias("e"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("label_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    met = own.join(counted, list(place), "left").join(copies, list(place), "left").join(said, F.col("id").cast("string") == F.col("label_id"), "left")
    n = F.coalesce("words", F.lit(0))
    failed = (n < 50, 100 * F.coalesce("distinct", F.lit(0)) < 65 * n, F.col("c"), F.col("d"), F.coalesce("e", F.lit(False)))
    pattern = sum((f.cast("int") * (1 << i) for i, f in enumerate(failed)), F.lit(0))
    return met.select("part", pattern.alias("pattern"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def conditional_counts(found: DataFrame) -> DataFrame:
    """One row a part: `n`, `good` and `toxic`, arrays of the documents of each pattern."""
    kinds = {"n": "", "good": "AND good", "toxic": "AND toxic"}
    columns = [F.expr(f"count_if(pattern = {m} {of}) AS {kind}{m}") for kind, of in kinds.items() for m in range(PATTERNS)]
    wide = found.groupBy("part").agg(*columns)
    return wide.select("part", *(F.array(*(f"{kind}{m}" for m in range(PATTERNS))).alias(kind) for kind in kinds))


def audit(docs: DataFrame, labels: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): each part, each
    order of the filters, each step of it."""
    counts = conditional_counts(patterns(docs, labels, part, id_col, text_col))
    orders = F.explode(F.lit(["".join(order) for order in permutations(FILTERS)]))
    rows = counts.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = {1 << i: F.instr("filter_order", letter) for i, letter in enumerate(FILTERS)}
    own = sum((F.when(at == F.col("step"), bit).otherwise(0) for bit, at in place.items()), F.lit(0))
    before = sum((F.when(at < F.col("step"), bit).otherwise(0) for bit, at in place.items()), F.lit(0))
    rows = rows.select("*", own.alias("own"), before.alias("before"))

    def total(kind: str, weight) -> Column:
        """Sum over the patterns of their count times the weight of a pattern."""
        pairs = F.arrays_zip(F.sequence(F.lit(0), F.lit(PATTERNS - 1)).alias("m"), F.col(kind).alias("c"))
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x["c"] * weight(x["m"]))

    before, own = F.col("before"), F.col("own")
    fails = lambda m: m.bitwiseAND(own) != 0
    here = lambda m: (fails(m) & (m.bitwiseAND(before) == 0)).cast("long")
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: (m.bitwiseAND(before.bitwiseOR(own)) == 0).cast("long")).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: (fails(m) & (m.bitwiseAND(before) != 0)).cast("long")).alias("redundant"),
        total("n", lambda m: (m == own).cast("long")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        # of the orders, the filter comes first among those that a document fails in one of so many
        total("n", lambda m: F.when(fails(m), F.lit(ORDERS).cast("long") / F.bit_count(m)).otherwise(0).cast("long")).alias("shapley"),
    )
