"""Mixing sources to target weights by weighted fair queueing (operator 3).

Every source is a queue of its documents in an order given by a hash, repeated for up to ``max_repeats`` passes. A
document's virtual finish time is the number of its source's words up to and with it, over all passes, divided by
the source's target. All entries are range-sorted by finish time over all sources, and the mix is cut where the
running total of words would exceed the budget. Every entry of every pass is sorted, so a source of few giant documents is cut as any other.

Both running totals are sums in two levels, so that neither a source with most of the rows nor the whole mix lands
in one task: a source's order is cut into 4096 ranges of its hash, whose totals are summed first; the global order
is cut by range partitioning, whose totals are summed first.

Defined results: a null text has no words, as an empty one; sources stand in code point order, a null source last,
and weigh 5, 2, 1, repeating. Documents without words are taken whenever their turn comes, and add nothing. Rows
that agree in id and size are ties: they take places next to each other and each is its own row. A null id is an id.
With no words at all every target is 0. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolens.llm.common import materialise, word_count

#: Fixed values.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
#: Hex digits of the order hash that name a range of a source's queue.
RANGE_DIGITS = 3
#: Entries of the cut's range that one task may sum row by row; a range of more is cut into ranges again.
CUT_ROWS = 1 << 13
MOST_RANGES = 1000
#: Words of a range of the mix, about, as long as there aren't too many ranges for one sample of their bounds.
RANGE_WORDS = 1 << 20
MOST_MIX_RANGES = 10_000


def sized_queue(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str) -> DataFrame:
    """doc_id, source, __nosrc, __src, size and __h, the place in the source's queue."""
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.col(source_col).isNull().alias("__nosrc"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__src"),
        word_count(F.col(text_col)).alias("size"),
        order.alias("__h"),
    )


def targets(queue: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row for each source: __nosrc, __src, source_size, __rank, target.

    Shares in proportion to the weights, none above ``max_repeats`` times the source's size: in the order of
    cap / weight, a source stops at its cap as long as the rest, shared by weight, would exceed it.
    The windows here run over one row for each source, not over documents.
    """
    sums = queue.groupBy("__nosrc", "__src").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("__nosrc", "__src"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * max_repeats
    by_cap = Window.orderBy(F.col("__cap") / F.col("__w"), "__rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.col("__cap") * F.col("__w_rest") <= F.col("__w") * (F.col("__total") - F.col("__cap_before"))
    shared = (
        sums.withColumns({"__rank": place, "__w": weight.cast("long"), "__cap": cap})
        .withColumns({"__cap_before": F.coalesce(F.sum("__cap").over(before), F.lit(0)), "__w_rest": F.sum("__w").over(rest), "__total": F.sum("source_size").over(everything)})
        .withColumn("__capped", capped)
    )
    open_cap = F.sum(F.when(F.col("__capped"), F.col("__cap")).otherwise(0)).over(everything)
    open_w = F.sum(F.when(F.col("__capped"), 0).otherwise(F.col("__w"))).over(everything)
    target = F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(F.col("__w") * (F.col("__total") - open_cap) / open_w)
    return shared.select("__nosrc", "__src", "source_size", "__rank", target.cast("double").alias("target"))


def _finish(passed: Column) -> Column:
    """Virtual finish time of the document in a pass (from 0); null where the target is 0."""
    return F.try_divide((passed * F.col("source_size") + F.col("__cum")).cast("double"), F.col("target"))


def _first_out(ranged: DataFrame, order: list[str], budget: int) -> Column | None:
    """The place of the first entry with which the running total exceeds the budget; null if all fit.

    One row for each range is summed; the range with the cut is cut into ranges again until one task can sum its entries.
    """
    left, part = budget, ranged
    while True:
        totals = part.groupBy("__pid").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).withColumn("upto", F.sum("n").over(Window.orderBy("__pid")))
        at = totals.where(F.col("upto") > left).orderBy("__pid").limit(1).collect()
        if not at:
            return None
        left -= at[0]["upto"] - at[0]["n"]
        inside = part.where(F.col("__pid") == at[0]["__pid"]).drop("__pid")
        if at[0]["rows"] <= CUT_ROWS:
            break
        # A number of ranges of their own, which adaptive execution doesn't merge; no two entries have one place.
        ranges = min(MOST_RANGES, 2 * -(-at[0]["rows"] // CUT_ROWS))
        part = materialise(inside.repartitionByRange(ranges, *order).withColumn("__pid", F.spark_partition_id()), "cut")
    run = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = inside.withColumn("__run", run).where(F.col("__run") > left).agg(F.min(F.struct(*order)).alias("cut")).first()["cut"]
    return F.struct(*[F.lit(first[c]).cast(ranged.schema[c].dataType).alias(c) for c in order])


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(documents, mix).

    documents has a row for each row of docs: doc_id, source, size, source_size, target, taken, passes.
    mix has a row for each entry of the cut mix, range-partitioned and sorted by finish: doc_id, source, size, pass, finish, part, place (range and
    order within it, a struct).
    """
    spark = docs.sparkSession
    queue = materialise(sized_queue(docs, id_col, source_col, text_col, seed).withColumn("__range", F.substring("__h", 1, RANGE_DIGITS)), "queue")
    by_source = targets(queue, weights, max_repeats)
    keys = ["__nosrc", "__src"]
    sums = queue.groupBy(*keys, "__range").agg(F.sum("size").alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start")).join(by_source, keys)
    within = Window.partitionBy(*keys, "__range").orderBy("__h", "doc_id", "size")
    placed = materialise(
        queue.join(starts, [*keys, "__range"])
        .withColumn("__pos", F.row_number().over(within))
        .withColumn("__cum", F.col("__start") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .select("doc_id", "source", "size", "source_size", "target", "__rank", "__h", "__pos", "__cum"),
        "placed",
    )
    order = ["finish", "__rank", "pass", "__h", "__pos"]
    entries = (
        placed.where(F.col("target") > 0)
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .withColumn("finish", _finish(F.col("pass")))
        .select("doc_id", "source", "size", *order)
    )
    budget = by_source.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget")).first()["budget"]
    ranges = max(1, min(MOST_MIX_RANGES, max_repeats * -(-budget // RANGE_WORDS)))
    ranged = materialise(entries.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id()), "mix")
    cut = _first_out(ranged, order, budget)
    ordinal = F.struct(*order)
    in_mix = (lambda key: key < cut) if cut is not None else (lambda key: F.lit(True))
    passes = sum(
        (F.when((F.col("target") > 0) & in_mix(F.struct(_finish(F.lit(p)).alias("finish"), "__rank", F.lit(p).alias("pass"), "__h", "__pos")), 1).otherwise(0) for p in range(max_repeats)),
        F.lit(0),
    )
    documents = placed.withColumn("passes", passes).select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size")).cast("long").alias("taken"), "passes")
    return documents, ranged.where(in_mix(ordinal)).select("doc_id", "source", "size", "pass", "finish", F.col("__pid").alias("part"), ordinal.alias("place"))
