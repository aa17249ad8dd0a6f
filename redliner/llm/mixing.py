"""Mixing sources to target weights with Pfair scheduling, in DataFrame and SQL functions only.

A source of ``w`` parts in ``m`` gets block ``j`` (counted from 0) the release time ``floor(j m / w)`` and the deadline
``ceil((j + 1) m / w)``, in slots of one block.  In each slot the released block with the earliest deadline goes next (ties:
the source first in order).  As the parts add up to ``m``, every block is placed between its release and
its deadline, so a source is always less than one block away from its share while sources last.

Every source has parts of its own.  Parts are whole numbers: given weights to a millionth, without their common factor, or
thousandths of the source's documents to the ``power``.  Only if they add up to more than ``resolution`` are they scaled to
about that sum, each rounded and at least one; the shares held are then those of the rounded parts.

The schedule repeats every ``m`` slots, so the earliest-deadline choice is made for one period only, or for the slots that
are used if these are fewer, by one ``aggregate`` over at most ``resolution`` slots and one entry for each source;
the slot of any block of any source follows by arithmetic.  No document waits for another.

Documents of a source are numbered by prefix sums.  Ids are cut into ``BUCKETS`` equal intervals, an interval into ranges of
about ``RANGE_ROWS`` rows by its own least and largest id (a single id, also null: by a hash of the row); counts of (source,
interval) and of the ranges inside one are summed up, then rows are numbered inside each range.  So a source with a
third of all rows, far ids and often repeated ones are spread over many tasks.

Defined results: every row is placed, none is dropped or repeated; when a source ends, its slots stay empty and the others go
on in their mutual proportions; a null source is a source of its own; null ids come first; rows with equal ids are ordered by a
hash of the whole row, and equal rows can change places; an empty table gives an empty result; columns of the input named like an
added one are replaced.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS, BUCKETS, STEPS = 512, 4096, 512
#: Slots of a period whose table is broadcast (about a hundred bytes a slot); a longer one is joined by shuffle.
BROADCAST_SLOTS = 100_000
ADDED = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position")


def _parts(queues: DataFrame, weights: dict[str, float] | None, power: float, resolution: int) -> DataFrame:
    """``queues(queue, n)`` with whole ``parts``, at least one each."""
    if weights is None:
        share = F.floor(1000 * F.pow(F.col("n").cast("double"), F.lit(power)) + 0.5)
    else:
        whole = {k: max(1, round(v * 1_000_000)) for k, v in weights.items()}
        factor = gcd(*whole.values())
        given = F.create_map(*[F.lit(x) for k, v in whole.items() for x in ("s:" + k, v // factor)])
        share = F.coalesce(given[F.col("queue")], F.lit(min(whole.values()) // factor))
    every = F.sum("share").over(Window.partitionBy())  # a row for each source
    rounded = F.greatest(F.lit(1), F.expr(f"(2 * share * {resolution} + every) div (2 * every)"))
    rows = queues.withColumn("share", F.greatest(F.lit(1), share).cast("long")).withColumn("every", every)
    return rows.withColumn("parts", F.when(F.col("every") <= resolution, F.col("share")).otherwise(rounded)).select("queue", "n", "parts")


def schedule(queues: DataFrame, block: int) -> DataFrame:
    """``(queue, parts, period, k, slot_k)`` for ``queues(queue, n, parts)``: block ``k`` of a queue in slot ``slot_k`` of a period.

    The period is cut after the last slot that any block needs.
    """
    one = queues.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("queue", "parts", "n"))).alias("q"), F.sum("parts").alias("m")
    )
    needed = f"array_max(transform(q, x -> (((x.n + {block - 1}) div {block}) * m + x.parts - 1) div x.parts))"
    earliest = """
      array_min(transform(
        filter(sequence(0, size(q) - 1),
               i -> acc.served[i] < q[i].parts and (acc.served[i] * m) div q[i].parts <= t),
        i -> named_struct('deadline', ((acc.served[i] + 1) * m + q[i].parts - 1) div q[i].parts, 'i', i))).i"""
    kind = "array<struct<i:int,k:bigint,slot_k:bigint>>"
    # A run of steps appends to its own list, runs to a list of lists: no step copies all picks before it.
    steps = f"""aggregate(
      sequence(run * {STEPS}, least((run + 1) * {STEPS}, slots) - 1),
      named_struct('served', runs.served, 'picks', cast(array() as {kind})),
      (acc, t) -> transform(array({earliest}), p -> named_struct(
        'served', transform(acc.served, (x, i) -> if(i = p, x + 1, x)),
        'picks', array_append(acc.picks, named_struct('i', p, 'k', acc.served[p], 'slot_k', t))))[0])"""
    picks = F.expr(
        f"""aggregate(
          sequence(0L, (slots - 1) div {STEPS}),
          named_struct('served', transform(q, x -> 0L), 'out', cast(array() as array<{kind}>)),
          (runs, run) -> transform(array({steps}), y -> named_struct('served', y.served, 'out', array_append(runs.out, y.picks)))[0],
          runs -> flatten(runs.out))"""
    )
    return (
        one.where("m > 0")
        .withColumn("slots", F.least(F.col("m"), F.expr(needed)))
        .select("q", "m", F.explode(picks).alias("pick"))
        .select(
            F.expr("q[pick.i].queue").alias("queue"),
            F.expr("q[pick.i].parts").alias("parts"),
            F.col("m").alias("period"),
            "pick.k",
            "pick.slot_k",
        )
    )


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = 0.5,
    block: int = 32,
    resolution: int = 1_000_000,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with its block, the block's release, deadline and slot, and its place in the mixed order.

    ``weights`` are target weights by source; a source without one gets the least of them.  Without ``weights`` a source
    weighs its documents to the ``power``.
    """
    docs = docs.drop(*ADDED)
    source: Column = F.when(F.col(source_col).isNull(), F.lit("null")).otherwise(
        F.concat(F.lit("s:"), F.col(source_col).cast("string"))
    )
    doc = F.col(id_col).cast("long")
    low, high = docs.agg(F.min(doc), F.max(doc)).first()
    low, high = (0, 0) if low is None else (low, high)
    number = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    width = -(-(high - low + 1) // BUCKETS)
    bucket = F.when(doc.isNull(), F.lit(-1)).otherwise(F.floor((doc.cast("decimal(38,0)") - number(low)) / number(width))).cast("int")
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]

    # The rows travel as one column, so that no name of theirs clashes.
    placed = docs.select(
        F.struct(*docs.columns).alias("__row"), source.alias("__queue"), bucket.alias("__bucket"), doc.alias("__id"), F.xxhash64(*hashed).alias("__tie")
    )
    # At most BUCKETS + 1 rows.
    intervals = placed.groupBy(F.col("__bucket").alias("bucket")).agg(F.min("__id").alias("least"), F.max("__id").alias("largest"), F.ceil(F.count("*") / RANGE_ROWS).alias("ranges"))
    by_id = F.floor((F.col("__id").cast("decimal(38,0)") - F.col("least")) * F.col("ranges") / (F.col("largest").cast("decimal(38,0)") - F.col("least") + 1))
    by_row = F.floor((F.col("__tie").cast("double") / F.lit(2.0**64) + 0.5) * F.col("ranges"))
    placed = (
        placed.join(F.broadcast(intervals), F.col("__bucket") == F.col("bucket"))
        .withColumn("__range", F.when(F.coalesce(F.col("largest") > F.col("least"), F.lit(False)), by_id.cast("long")).otherwise(by_row.cast("long")))
        .drop("bucket", "least", "largest", "ranges")
    )
    counts = placed.groupBy("__queue", "__bucket", "__range").agg(F.count("*").alias("__n"))
    whole = counts.groupBy("__queue", "__bucket").agg(F.sum("__n").alias("__n"))
    before = Window.partitionBy("__queue").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    above = whole.withColumn("__above", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inner = Window.partitionBy("__queue", "__bucket").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(inner), F.lit(0))).drop("__n")
    starts = starts.join(above, ["__queue", "__bucket"]).select("__queue", "__bucket", "__range", (F.col("__before") + F.col("__above")).alias("__before"))
    inside = Window.partitionBy("__queue", "__bucket", "__range").orderBy(F.col("__id").asc_nulls_first(), "__tie")
    numbered = placed.withColumn("__in_range", F.row_number().over(inside) - 1)

    queues = _parts(whole.groupBy(F.col("__queue").alias("queue")).agg(F.sum("__n").alias("n")), weights, power, resolution)
    most = queues.agg(F.sum("parts")).first()[0] or 0
    period = schedule(queues, block)
    if most <= BROADCAST_SLOTS:
        period = F.broadcast(period)
    parts = F.broadcast(queues.select(F.col("queue").alias("__q"), F.col("parts").alias("__w"))) if most <= BROADCAST_SLOTS else queues.select(F.col("queue").alias("__q"), F.col("parts").alias("__w"))

    rows = (
        numbered.join(starts, ["__queue", "__bucket", "__range"])
        .withColumn("__at", F.col("__before") + F.col("__in_range"))
        .withColumn("mix_block", F.floor(F.col("__at") / block).cast("long"))
        .join(parts, F.col("__queue") == F.col("__q"))
        .withColumn("__k", F.col("mix_block") % F.col("__w"))
    )
    return (
        rows.join(period, (rows["__queue"] == period["queue"]) & (rows["__k"] == period["k"]))
        .withColumn("mix_release", F.expr("(mix_block * period) div parts"))
        .withColumn("mix_deadline", F.expr("((mix_block + 1) * period + parts - 1) div parts"))
        .withColumn("mix_slot", F.expr("(mix_block div parts) * period + slot_k"))
        .withColumn("mix_position", F.col("mix_slot") * block + F.col("__at") % block)
        .select("__row.*", *ADDED)
    )
