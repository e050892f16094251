"""Mixing sources to target weights by Pfair scheduling (DataFrame operations only).

A source is cut into blocks of at most ``BLOCK`` rows.  A period holds p blocks of a
source, and the p's of all sources add up to its slots.  Block j of p (from 0) is
released at floor(j * slots / p) and due at ceil((j + 1) * slots / p); each slot takes
the released block that is due first.  So after any t slots a source has had less than
one block more or less than p * t / slots.

Only whole blocks are scheduled, but nothing is rounded away: a source's blocks hold as
many rows as its exact weight asks for.  With ``quota`` rows a period, period m holds the
rows from floor(m * quota) to floor((m + 1) * quota), dealt evenly to its p blocks.  Every
period has the same slots, so the schedule is made once, and a row's place follows from
its rank by arithmetic.  However long the table, a source stays within one block of its
target weight.

Sources that need one block a period or less are released at its start and due at its
end: they take the slots that the others leave free, without being part of the schedule's
fold, so there may be very many of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import Sealed, gapless_rank, materialize

BLOCK = 16
#: A period holds this many blocks' worth of rows.
PERIOD = 1000
#: Buckets in which a source's rows are numbered.
BUCKETS = 512
#: Quotas are whole numbers of 1 / UNIT rows a period: an error below 1 row in 2^23 periods.
UNIT = 1 << 22
#: Slots that the schedule's fold puts in one array.
STRETCH = 512


def quotas(weights: DataFrame, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """(source, weight > 0) to (source, k, q, p, slots): rows a period in units, blocks a period, slots of the period.

    Sources are numbered by ``k`` in order of their names; one row for each is put in sequence here.
    """
    every = Window.partitionBy(F.lit(0))
    rows = weights.select("source", F.col("weight").cast("double").alias("weight"))
    quota = F.col("weight") / F.sum("weight").over(every) * float(block * period)
    rows = rows.withColumn("quota", quota)
    # Blocks are two rows short, so that with what rounding adds they hold ``block`` at most.
    rows = rows.select(
        "source",
        F.greatest(F.round(F.col("quota") * float(UNIT)).cast("long"), F.lit(1).cast("long")).alias("q"),
        F.greatest(F.ceil(F.col("quota") / float(max(1, block - 2))).cast("long"), F.lit(1).cast("long")).alias("p"),
    )
    return rows.select("source", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source")) - 1).alias("k"), "q", "p", F.sum("p").over(every).alias("slots"))


def _let(value: Column, then) -> Column:
    """``then`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def schedule(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """What ``quotas`` gives to (source, slots of its blocks in a period, in order): earliest deadline first."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    start = F.struct("k", "p", zero.alias("done"))
    state = rows.groupBy().agg(F.array_sort(F.collect_list(F.when(F.col("p") > 1, start))).alias("s"), F.max("slots").alias("slots")).where("slots > 0")

    def step(now: Column, t: Column) -> Column:
        def offer(x: Column, i: Column) -> Column:
            released = F.floor(x["done"] * F.col("slots") / x["p"]) <= t
            due = F.ceil((x["done"] + one) * F.col("slots") / x["p"])
            return F.when(released & (x["done"] < x["p"]), F.struct(due.alias("due"), i.alias("i")))

        def take(i: Column) -> Column:
            moved = F.transform(now["s"], lambda x, j: F.when(j == i, F.struct(x["k"].alias("k"), x["p"].alias("p"), (x["done"] + one).alias("done"))).otherwise(x))
            return F.struct(moved.alias("s"), F.array_append(now["out"], F.get(now["s"], i)["k"]).alias("out"))

        return _let(F.array_min(F.transform(now["s"], offer))["i"], take)

    empty = F.array().cast("array<int>")

    def many(now: Column, c: Column) -> Column:
        steps = F.sequence(c, F.least(c + stretch, F.col("slots")) - 1)
        begun = F.struct(now["s"].alias("s"), empty.alias("out"))
        return _let(F.aggregate(steps, begun, step), lambda x: F.struct(x["s"].alias("s"), F.array_append(now["all"], x["out"]).alias("all")))

    # A short array is appended to for each slot, a long one for each stretch only.
    begun = F.struct(F.col("s"), F.array().cast("array<array<int>>").alias("all"))
    run = state.select(F.aggregate(F.sequence(zero, F.col("slots") - 1, F.lit(stretch).cast("long")), begun, many)["all"].alias("all"))
    taken = run.select(F.posexplode("all").alias("c", "part")).select("c", F.posexplode("part").alias("at", "k"))
    taken = materialize(taken.select((F.col("c") * stretch + F.col("at")).cast("long").alias("slot"), "k"), "mixing-slots")
    alone = Window.partitionBy(F.lit(0))
    free = taken.where("k IS NULL").select("slot", F.row_number().over(alone.orderBy("slot")).alias("nth"))
    light = rows.where("p = 1").select("k", F.row_number().over(alone.orderBy("k")).alias("nth"))
    every = taken.where("k IS NOT NULL").select("k", "slot").union(light.join(free, "nth").select("k", "slot"))
    return rows.join(every.groupBy("k").agg(F.array_sort(F.collect_list("slot")).alias("at")), "k").select("source", "at")


def natural_weights(docs: DataFrame, source: str = "source", power: float = 1.0) -> DataFrame:
    """(source, weight): number of rows to the power ``power``; 1 mixes evenly, less favours small sources."""
    return docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(power)).alias("weight"))


def mix(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", id_col: str = "doc_id", block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """All rows and columns of ``docs`` plus mix_block, mix_slot and mix_row (long).

    ``mix_block`` numbers the blocks of a row's source, ``mix_slot`` is the slot of that
    block in the schedule, ``mix_row`` the row's place in the block: ordering by
    (mix_slot, mix_row) gives the mixture.  ``weights`` (source, weight) default to the
    sources' sizes.  Rows of sources without a positive weight get nulls; sources with a
    weight and no rows leave their slots empty.  A slot stands for ``block`` * ``period``
    rows shared out over the slots of a period, and until it runs dry a source has after
    any number of slots less than ``block`` rows more or less than its exact share of
    that; no row is dropped or repeated.  Null sources count as the source "".  Within a
    source rows are dealt out by a hash of the id.  Columns of ``docs`` keep their names,
    but for those named like the three outputs, which give way.
    """
    sealed = Sealed(docs)
    named = sealed.df.withColumn("_source", F.coalesce(sealed[source].cast("string"), F.lit("")))
    weights = natural_weights(docs, source) if weights is None else weights.where("weight > 0 AND source IS NOT NULL")
    rows = materialize(quotas(weights, block, period), "mixing-quotas")
    plan = materialize(rows.join(schedule(rows), "source"), "mixing-plan")
    key = F.coalesce(sealed[id_col].cast("string"), F.lit("null"))
    bucket = F.conv(F.substring(F.md5(key), 1, 5), 16, 10).cast("long") % BUCKETS
    facts = plan.select(F.col("source").alias("_g"), "q", "p", "slots", "at")
    ranked = gapless_rank(named, "_source", [sealed[id_col]], bucket, "_rank", facts)
    # Whole numbers throughout: the row's period, the rows of that period, its block there.
    ranked = ranked.withColumn("_m", F.expr(f"((_rank + 1) * {UNIT} - 1) div q"))
    ranked = ranked.withColumn("_off", F.expr(f"_rank - (_m * q) div {UNIT}")).withColumn("_n", F.expr(f"((_m + 1) * q) div {UNIT} - (_m * q) div {UNIT}"))
    ranked = ranked.withColumn("_j", F.expr("((_off + 1) * p - 1) div _n"))
    return sealed.restored(
        ranked,
        mix_block=F.expr("_m * p + _j"),
        mix_slot=F.expr("_m * slots") + F.get("at", F.col("_j").cast("int")),
        mix_row=F.expr("_off - (_j * _n) div p"),
    )
