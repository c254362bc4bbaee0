"""Mixing sources to target weights by weighted fair queueing (native).

Each source's documents are shuffled by a hash and queued, the queue repeated up to ``max_repeat`` times. A copy is served in quanta: parts of at most 1/QUANTA of its
source's target (most copies are one quantum). A quantum's virtual finish time is the words its source has served by its end, divided by the source's target. All
quanta are range-sorted by that time over all partitions, and the order is cut where its running total reaches the budget: sums of the sorted partitions are put in
line, and only the one partition in which the budget ends is summed up row by row. So every source stops within a quantum of its target, and all of them together
take the budget to the word.

A running sum over a hot source isn't one task: a source's queue is split into BUCKETS hash ranges, whose sums are aggregated before any shuffle, and only the ranges' sums are put in line. Equal rows
share a hash; they are summed up for each partition that they were read in, so a row that is repeated very often isn't gathered either. Windows over sources alone see one row a source.

Defined cases: sources stand by code point, null last (null is a source of its own, unlike an empty name). A null text has no words; documents without words take part with 0 taken. Very long
texts are counted whole and served in quanta like any other. Repeated rows are documents each for themselves and interchangeable. Quanta of equal finish time go by source, then by place in its queue.
A source whose fair share exceeds ``max_repeat`` times its size gets that, and the rest is shared anew. No document is taken more than ``max_repeat`` times. An empty table gives no rows. Only id, text and source
are worked on; mix_documents() keeps the other columns whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshfront.llm.common import WORD, free_name
from meshfront.plans.storage import materialize

#: Hash ranges of each source.
BUCKETS = 4096
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Quanta that a source's target has at least, where its words allow.
QUANTA = 1000
#: Bits of a row number that count rows inside its partition.
_ROW_BITS = 33


def _source_key(source: Column) -> Column:
    """Sorts sources by code point with null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def sized_documents(docs: DataFrame, seed: str = "mix", row: Column | None = None) -> DataFrame:
    """``(row, doc_id, skey, size, key)`` for each document, written once: every later pass reads words counted, not texts."""
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text).cast("binary"))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    number = F.monotonically_increasing_id() if row is None else row
    return materialize(docs.select(number.alias("row"), "doc_id", _source_key(F.col("source")).alias("skey"), size.alias("size"), key.alias("key")), "sized")


def _quantum() -> Column:
    """Words that a source serves at a time."""
    return F.greatest(F.lit(1), F.floor(F.col("target") / QUANTA)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, max_repeat: int = 3, budget: int | None = None) -> DataFrame:
    """``(skey, source_size, target, total, latest)`` a source. Targets share the budget ``total`` (all words by default) by weight; by the virtual time ``latest`` every source has served its target."""
    by_name, by_cap, whole = Window.orderBy("skey"), Window.orderBy(F.col("cap") / F.col("w"), "skey"), Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_repeat)
    total = F.sum("source_size").over(whole) if budget is None else F.lit(budget).cast("long")
    ahead = F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    s = s.withColumns({"total": total, "ahead": ahead, "left": left})
    s = s.withColumn("full", F.col("cap") / F.col("w") <= (F.col("total") - F.col("ahead")) / F.col("left"))
    open_words = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * open_words / open_weight)
    s = s.select("skey", "source_size", target.alias("target"), "total")
    return s.withColumn("latest", F.max(1 + F.try_divide(_quantum(), F.col("target"))).over(whole))


def _lined_up(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """Documents with words and the words ahead of them in their source's queue, ``start``."""
    bucket = F.conv(F.substring("key", 1, 3), 16, 10).cast("int") % BUCKETS
    rows = sized.where("size > 0").withColumns({"bucket": bucket, "part": F.shiftright("row", _ROW_BITS)})
    cell = ["skey", "bucket", "key", "part"]
    ahead = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*cell).agg(F.sum("size").alias("words"))
    in_bucket = F.coalesce(F.sum("words").over(ahead("key", "part").partitionBy("skey", "bucket")), F.lit(0))
    cells = cells.select(*cell, in_bucket.alias("in_bucket"))
    buckets = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    in_source = F.coalesce(F.sum("words").over(ahead("bucket").partitionBy("skey")), F.lit(0))
    buckets = buckets.select("skey", "bucket", in_source.alias("in_source")).join(shares, "skey")
    in_cell = F.coalesce(F.sum("size").over(ahead("row").partitionBy(*cell)), F.lit(0))
    rows = rows.withColumn("in_cell", in_cell).join(cells, cell).join(buckets, ["skey", "bucket"])
    return rows.select("row", "skey", "size", "source_size", "target", "latest", (F.col("in_source") + F.col("in_bucket") + F.col("in_cell")).alias("start"))


def queue(sized: DataFrame, shares: DataFrame, max_repeat: int = 3) -> DataFrame:
    """The quanta of all copies that the mix may take, range-sorted by virtual finish time: ``(row, size, skey, epoch, start, words, virtual_finish)``.

    By ``latest`` the sources have served the whole budget, so later quanta can't be taken and aren't made: of ``max_repeat`` rounds of the queue about one is sorted.
    """
    rows = _lined_up(sized, shares).withColumn("quantum", _quantum())
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))).alias("epoch"))
    first = F.col("start") + F.col("epoch") * F.col("source_size")
    rows = rows.where(first <= F.col("latest") * F.col("target") * (1 + 1e-9))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("quantum")))).alias("k"))
    begin = first + F.col("k") * F.col("quantum")
    words = F.least("quantum", F.col("size") - F.col("k") * F.col("quantum"))
    finish = ((begin + words) / F.col("target")).alias("virtual_finish")
    out = rows.select("row", "size", "skey", "epoch", begin.alias("start"), words.alias("words"), finish, "latest").where(F.col("virtual_finish") <= F.col("latest") * (1 + 1e-9)).drop("latest")
    by = ["virtual_finish", "skey", "start"]
    return out.repartitionByRange(*by).sortWithinPartitions(*by)


def schedule(sized: DataFrame, weights=WEIGHTS, max_repeat: int = 3, budget: int | None = None) -> DataFrame:
    """The quanta that the mix takes, ``taken`` words of each: the order of queue() up to the budget."""
    shares = targets(sized, weights, max_repeat, budget)
    order = materialize(queue(sized, shares, max_repeat).withColumn("shard", F.spark_partition_id()), "schedule")
    # One row a sorted partition: what comes before it in the order. The last one that begins below the budget is the only one to be cut.
    sums = order.groupBy("shard").agg(F.sum("words").alias("n"))
    line = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    total = shares.agg(F.max("total").alias("total"))
    shards = sums.select("shard", "n", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before")).join(F.broadcast(total), F.lit(True))  # one row
    shards = shards.where("before < total").select("shard", (F.col("total") - F.col("before")).alias("left"), "n")
    rows = order.join(F.broadcast(shards), "shard")  # a row for each partition of the order
    ahead = Window.partitionBy("shard").orderBy("virtual_finish", "skey", "start").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.where("n > left").withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    cut = last.where("ahead < left").withColumn("taken", F.least("words", F.col("left") - F.col("ahead")))
    names = ["row", "size", "skey", "epoch", "start", "words", "virtual_finish", "shard"]
    return rows.where("n <= left").select(*names, F.col("words").alias("taken")).unionAll(cut.select(*names, "taken"))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """What the mix takes of every document: ``(doc_id, size, source_size, target, taken)``."""
    sized = sized_documents(docs)
    taken = schedule(sized, **how).groupBy("row").agg(F.sum("taken").alias("taken"))
    rows = sized.join(taken, "row", "left").join(targets(sized, **how).drop("latest"), "skey")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document's row as often as the mix takes at least half of it, whole and with all its columns."""
    row, copies = (free_name(docs.columns, n) for n in ("row", "copies"))
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    sized = sized_documents(numbered.select(F.col(f"`{row}`"), "doc_id", "text", "source"), row=F.col(row))
    own = schedule(sized, **how).groupBy("row", "epoch").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"))
    times = own.where("2 * taken >= size").groupBy("row").agg(F.count("*").cast("int").alias(copies)).withColumnRenamed("row", row)
    out = numbered.join(times.hint("merge"), row)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array_repeat(F.lit(0), F.col(copies))).alias(copies)).select(*(F.col(f"`{c}`") for c in docs.columns))
