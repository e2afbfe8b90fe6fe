"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, parts_for, running_sum, staged

#: Rows of one range of the global order.
ROWS_PER_PART = 50_000


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_passes: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code-point order (null last) weigh ``weights``, repeating, and share the sum of
    all sizes. A target stops at ``most_passes`` times its source's size; what is above goes to
    the others by weight until none is above.

    A source is at its limit at every water level from limit/weight on. Sorted by that ratio,
    the level is the first at which the sources before it, full, and the rest, by weight, use
    up the total; so a few window functions over one row per source replace the rounds.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    places = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("_weight", F.element_at(places, (F.row_number().over(in_order) - 1) % len(weights) + 1))
    rows = rows.withColumn("_limit", F.col("source_size") * float(most_passes)).withColumn("_full_at", F.col("_limit") / F.col("_weight"))
    by_level, everything = Window.orderBy("_full_at", F.col("source").isNull(), "source"), Window.partitionBy(F.lit(1))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    share = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / share)
    # The first source that its own level does not fill sets the level of all later ones.
    place = F.struct("_full_at", F.col("source").isNull().alias("_none"), "source", "_level")
    level = F.min(F.when(F.col("_level") < F.col("_full_at"), place)).over(everything)
    rows = rows.withColumn("_stop", level)
    return rows.withColumn("target", F.coalesce(F.least("_limit", F.col("_weight") * F.col("_stop._level")), "_limit")).select("source", "source_size", "target")


def mix(docs: DataFrame, size: Column, id_column: str = "doc_id", source_column: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), most_passes: int = 3, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``id, source, size, source_size, target, taken`` and the ``carry`` columns.

    Every source queues its documents in a shuffled order, pass after pass (up to
    ``most_passes``, only as many as its target needs). A queued copy finishes at the virtual
    time "tokens of its source up to and with it, divided by the source's target". All copies
    are sorted by finish time over all sources, and the mix is what lies before the total
    budget, the sum of all sizes. ``taken`` is the number of tokens taken, repeats counted. A
    copy counts whole; the one across the budget's end is taken if more than half of it fits.

    The order depends on identifier, source and size alone, so reruns agree; rows alike in all
    three are interchangeable but for the place of their row in the input. Null sizes count as
    0. Documents of size 0 and sources without tokens take nothing. No rows give no rows.
    """
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.struct(F.lit(0), *carry).alias("_carry"),
    ).withColumn("_row", F.monotonically_increasing_id())
    rows = staged(rows)
    count = rows.count()
    sized = staged(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_passes))  # one row per source
    queue = rows.withColumn("_shuffle", F.xxhash64(F.lit(seed), F.col("id").cast("string"), "source", "size"))
    # Tokens of a source before and with each document: a running sum over all sources in turn, less those of the sources before.
    order = ["_none", "source", "_shuffle", "_row"]
    queue = running_sum(queue.withColumn("_none", F.col("source").isNull()), order, "size", "_sum", parts_for(count, ROWS_PER_PART))
    first = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("_before", F.coalesce(F.sum("source_size").over(first), F.lit(0)))
    queue = queue.join(sized, queue["source"].eqNullSafe(sized["source"])).drop(sized["source"])
    needed = F.ceil(F.col("target") / F.col("source_size"))
    copies = (
        queue.where("size > 0 AND source_size > 0")
        .withColumn("_pass", F.explode(F.sequence(F.lit(0), F.greatest(needed, F.lit(1)) - 1)))
        .withColumn("_served", F.col("_sum") - F.col("_before") + F.col("_pass") * F.col("source_size"))
        .withColumn("_finish", F.col("_served") / F.col("target"))
        .select("_row", "_finish", "_none", "source", "_pass", "size")
    )
    order = ["_finish", "_none", "source", "_row", "_pass"]
    total = sized.agg(F.sum("source_size")).first()[0] or 0
    served = running_sum(copies, order, "size", "_total", parts_for(most_passes * count, ROWS_PER_PART))
    taken = served.where(F.col("_total") - F.col("size") / 2 < F.lit(total)).groupBy("_row").agg(F.sum("size").alias("taken"))
    return (
        queue.join(taken, "_row", "left")
        .select("id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *[F.col("_carry")[c].alias(c) for c in carry])
    )
