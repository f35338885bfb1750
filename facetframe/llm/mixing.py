"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

1. Every document's size is its word count; a source's weight comes from its position in the
   code-point order of sources (null last), cycling through ``weights``.
2. The budget is ``share`` times all sizes. A source's target is its weight's part of it, at
   most ``cap`` times its own size; what is cut off goes to the others by weight (the water
   level of the capped shares, computed in closed form over the sources).
3. Documents of a source queue in a seeded hash order. A copy's virtual finish time is the
   source's words up to it, divided by the source's target; the second copy of a document
   queues after the whole first pass. Of the copy itself half counts, so that a long document
   at the cut is taken if most of it lies before the cut: a source misses its target by at
   most about half a document.
4. All copies are sorted globally by finish time (range partitions, written once) and taken until
   the budget is used up. Sums of whole partitions find the partition that holds the cut, and only
   that one is summed row by row.

A source's running word count is the sum of whole hash ranges before a document's range plus
the running sum within it, so a source with a third of all rows is spread over as many groups
as there are ranges. Rows equal in id, text and source are counted before they queue and queue one
behind the other, so they are no hot group and the cut may fall between them.

Edge cases: null or empty text has size 0 and is never taken; null is a source of its own;
rows equal in id and text queue one behind the other, which of them the mix takes is decided by
their other columns; extra columns are ignored (:func:`mix_documents` keeps them); an empty table
gives an empty result. The result depends only on the rows and ``seed``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetframe.llm.common import WORD_PATTERN, shared_table

_KEYS = ("id", "u", "source", "size")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target); one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = (sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(cap))
         .withColumn("r", F.col("most") / F.col("w")))
    before = Window.orderBy("r", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) \
        / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level)
    return s.select("source", "source_size",
                    F.least("most", F.max("level").over(every) * F.col("w")).alias("target"))


def _queue_key(id_col, text_col, seed: int):
    return F.xxhash64(F.lit(seed), id_col, text_col)


def queue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
          seed: int = 20) -> tuple[DataFrame, tuple[float, int]]:
    """One row per document: (id, u, source, size, source_size, target, k, upto), and where in the
    order of (finish time, u) the budget is used up. ``upto``: words of the source up to the
    document's middle; ``k``: its number, from 0, among rows equal in id, text and source."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    narrow = shared_table(docs.select(
        F.col(id_col).alias("id"), _queue_key(F.col(id_col), F.col(text_col), seed).alias("u"),
        F.col(source_col).alias("source"), size.alias("size"))
        .groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, math.ceil(math.log2(partitions)))
    narrow = narrow.withColumn("range", F.shiftright("u", 64 - bits))
    by_range = shared_table(narrow.groupBy("source", "range").agg(F.sum(F.expr("size * n")).alias("range_size")),
                            "mix-ranges")
    targets = shared_table(source_targets(
        by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, cap),
        "mix-targets")
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shared_table(by_range.select(
        "source", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("words_before")),
        "mix-offsets").alias("o")
    inside = (Window.partitionBy("source", "range").orderBy("u", F.col("id").asc_nulls_first(), "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    run = narrow.withColumn("run", F.coalesce(F.sum(F.expr("size * n")).over(inside), F.lit(0))).alias("n")
    q = (run.join(offsets, F.expr("n.source <=> o.source and n.range = o.range"))
         .join(targets.alias("t"), F.expr("n.source <=> t.source"))
         .selectExpr("n.id", "n.u", "n.source", "n.size", "t.source_size", "t.target",
                     "o.words_before + n.run as before", "explode(sequence(0L, n.n - 1)) as k")
         .selectExpr("id", "u", "source", "size", "source_size", "target", "k",
                     "before + k * size + size / 2 as upto"))
    q = shared_table(q, "mix-queue")

    budget = (targets.agg(F.sum("source_size").alias("s")).first()["s"] or 0) * share
    copies = q.where("size > 0").selectExpr(
        "size", "u", "explode(array(upto / target, (source_size + upto) / target)) as v")
    ordered = shared_table(copies.repartitionByRange(partitions, "v", "u").withColumn("p", F.spark_partition_id()),
                           "mix-order")
    to_here = (ordered.groupBy("p").agg(F.sum("size").alias("s"))
               .select("p", "s", F.sum("s").over(Window.orderBy("p")).alias("c")))
    cut = to_here.where(F.col("c") > budget).orderBy("p").first()
    if cut is None:
        return q, (math.inf, 0)
    rows = Window.orderBy("v", "u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = ordered.where(F.col("p") == cut["p"]).select("v", "u", F.sum("size").over(rows).alias("c"))
    beyond = (one.where(F.col("c") > budget - (cut["c"] - cut["s"]))
              .agg(F.min(F.struct("v", "u")).alias("at")).first()["at"])
    return q, (beyond["v"], beyond["u"])


def _passes(end: tuple[float, int]) -> tuple[Column, Column]:
    """Whether the first and the second copy of a queued document lie before the cut."""
    u, target = F.col("u"), F.nullif(F.col("target"), F.lit(0.0))  # a source without words has none

    def before(words: Column) -> Column:
        v = words / target
        return (F.col("size") > 0) & F.coalesce((v < end[0]) | ((v == end[0]) & (u < end[1])), F.lit(False))
    return before(F.col("upto")), before(F.col("source_size") + F.col("upto"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: (id_col, size, source_size, target, taken)."""
    q, end = queue(docs, id_col=id_col, **options)
    times = sum((p.cast("long") for p in _passes(end)), F.lit(0))
    return q.select(F.col("id").alias(id_col), "size", "source_size", "target",
                    (times * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", seed: int = 20, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken (0, 1 or 2 times).

    Within a source the rows taken in a pass are a prefix of the queue, so the texts are only
    joined to one cut per source and pass. A cut names the last document taken and how many of
    the rows equal to it are taken; only these rows are counted and numbered, by all their columns.
    """
    q, end = queue(docs, id_col, text_col, source_col, seed=seed, **options)
    first, again = _passes(end)
    last = F.struct("u", (F.col("k") + 1).alias("n"))  # among equal rows the highest number taken
    cuts = shared_table(q.groupBy("source").agg(
        F.max(F.when(first, last)).alias("_first"), F.max(F.when(again, last)).alias("_again")), "mix-cuts")
    cuts = cuts.selectExpr("source as _cut_source", "_first.u as _u1", "_first.n as _n1",
                           "_again.u as _u2", "_again.n as _n2")
    some = F.coalesce(F.col(text_col).rlike(WORD_PATTERN), F.lit(False))
    rows = (docs.where(some).withColumn("_u", _queue_key(F.col(id_col), F.col(text_col), seed))
            .join(cuts, F.col(source_col).eqNullSafe(F.col("_cut_source"))))
    passes = [F.coalesce((F.col("_u") < F.col(u)).cast("int"), F.lit(0)) for u in ("_u1", "_u2")]
    at_cut = [F.coalesce(F.col("_u") == F.col(u), F.lit(False)) for u in ("_u1", "_u2")]
    on_cut = at_cut[0] | at_cut[1]
    whole = rows.where(~on_cut).withColumn("_times", (passes[0] + passes[1]).cast("long"))
    # rows at a cut: equal rows are counted, variants are laid behind one another
    helpers = ["_cut_source", "_u", "_u1", "_n1", "_u2", "_n2"]
    tied = rows.where(on_cut).groupBy(*[rows[c] for c in docs.columns], *helpers).agg(F.count(F.lit(1)).alias("_n"))
    variants = Window.partitionBy("_cut_source", "_u").orderBy(F.xxhash64(*docs.columns), *docs.columns).rowsBetween(
        Window.unboundedPreceding, -1)
    tied = tied.withColumn("_before", F.coalesce(F.sum("_n").over(variants), F.lit(0)))
    taken = [F.when(cut, F.greatest(F.lit(0), F.least(F.col("_n"), F.col(n) - F.col("_before"))))
             .otherwise(F.col("_n") * less) for cut, n, less in zip(at_cut, ("_n1", "_n2"), passes)]
    tied = tied.withColumn("_times", (taken[0] + taken[1]).cast("long"))
    out = whole.select(*docs.columns, "_times").unionByName(tied.select(*docs.columns, "_times"))
    return (out.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
            .select(*docs.columns))
