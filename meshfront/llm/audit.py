"""How filters interact: what each removes under every order, from one histogram of failure masks.

Native expressions give each document a mask of the filters it fails. The one filter that needs other documents, identical texts, comes from grouping texts (by SHA-256 digest, so no text is shuffled) for the
least id. Counts by part and mask, at most 32 cells a part, hold all that any order of the filters can do: a filter removes the cells that have its bit and none of those before it. The 120 orders are enumerated from the cells, never from documents.

Groups of copies and repeated rows may hold any share of all rows: rows are counted by (id, digest, part, mask) first, then by (digest, part, mask, labels) with the count of the least id carried along, both with
partial aggregates; what is left of a digest is a row for each part and label, and only those rows meet in a window.

Defined cases: a null text is the empty one, which fails A only (and E, like any other text); a null lang is the part ``''``. A null doc_id is neither smaller nor larger than another: such a document never fails E and makes no other fail it.
Rows that repeat an id and its text are documents each for themselves, and none of them is a copy of the other. A document counts as good or toxic if any of the labels with its id says so; without labels it is neither. An empty table gives no rows.
Only the named columns are read, whatever the others' names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshfront.llm.common import UPPER, WORD

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 100, 80, 10
#: Fixed value: characters of filter D.
SYMBOLS = "[#$%&*|]"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_failures(text: Column) -> Column:
    """The bits of the filters that a text fails by itself: A 1, B 2, C 4, D 8."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.transform(F.array(words), lambda w: (
        F.when(F.size(w) < MIN_WORDS, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(w)).cast("long") < MIN_DISTINCT * F.size(w).cast("long"), 2).otherwise(0)
        + F.when(100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long") > MAX_UPPER * F.length(text).cast("long"), 4).otherwise(0)
        + F.when(text.rlike(SYMBOLS), 8).otherwise(0)
    ))[0]


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each part by what they fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("`doc_id`").alias("doc_id"), F.coalesce(F.col("`lang`"), F.lit("")).alias("part"), F.col("`text`").alias("text"))
    rows = rows.select("doc_id", "part", own_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.where(F.col("`doc_id`").isNotNull()).groupBy(F.col("`doc_id`").alias("doc_id")).agg(
        *(F.max((F.col(f"`{c}`") == 1).cast("int")).alias(v) for c, v in (("quality", "good"), ("toxic", "toxic")))
    )
    # Rows without an id meet no label and no copy, so they needn't be shuffled by a key they all share.
    nameless = rows.where("doc_id IS NULL").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    marked = rows.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    same = ["digest", "part", "mask", "good", "toxic"]
    texts = marked.groupBy(*same).agg(F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.sum("n").alias("n"))
    is_first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    texts = texts.withColumn("firsts", F.when(is_first, F.col("n_least")).otherwise(F.lit(0)))
    split = F.explode(F.array(*(F.struct(F.col("mask").bitwiseOR(bit).alias("mask"), n.alias("n")) for bit, n in ((0, F.col("firsts")), (16, F.col("n") - F.col("firsts"))))))
    split = texts.select("part", "good", "toxic", split.alias("c")).select("part", "c.mask", "c.n", "good", "toxic").where("n > 0")
    return split.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in ("good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: what that step keeps, removes, finds removed already, and loses of good and toxic documents, and the filter's share over all orders."""
    held = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders = F.lit(["".join(p) for p in permutations(FILTERS)])
    rows = held.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = F.expr("shiftleft(1, ascii(substr(filter_order, step, 1)) - 65)")
    before = F.expr("aggregate(transform(sequence(1, 5), k -> IF(k < step, shiftleft(1, ascii(substr(filter_order, k, 1)) - 65), 0)), 0, (a, b) -> a + b)")
    rows = rows.select("*", bit.alias("bit"), before.alias("gone"))
    total = lambda where, what: F.expr(f"aggregate(filter(cells, c -> {where}), 0L, (a, c) -> a + c.{what})")
    here = "c.mask & bit <> 0 AND c.mask & gone = 0"
    rows = rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("c.mask & (gone | bit) = 0", "n").alias("kept"), total(here, "n").alias("removed"), total("c.mask & bit <> 0 AND c.mask & gone <> 0", "n").alias("redundant"),
        total("c.mask = bit", "n").alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"), "bit",
    )
    return rows.select("part", "filter_order", "step", *_COUNTS, F.sum("removed").over(Window.partitionBy("part", "bit")).alias("shapley"))
