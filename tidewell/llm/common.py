"""Shared plumbing: the shared scratch folder, written intermediates, joins that bear hot keys, gapless ranks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    A folder of our own is made only where that setting is absent and the master is
    local, as in tests.  On a cluster its absence is an error: executors would write to
    disks of their own, and results would be incomplete.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="tidewell-")
    return _FALLBACK[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone at interpreter exit
        pass


def materialize(df: DataFrame, tag: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back, so lineage ends there.

    The copy is a table in shared storage: losing an executor costs only the
    tasks it was running.  Copies go with the ``scratch_scope`` around them (unless
    they are ``lasting``), or by ``release``, or when the driver exits.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (scope := _SCOPE.get()) is None or lasting:
        atexit.register(_remove, spark, path)
    else:
        scope.append(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy._scratch = path
    return copy


def release(*copies: DataFrame) -> None:
    """Remove copies that ``materialize`` made, once nothing reads them any more."""
    for copy in copies:
        if path := getattr(copy, "_scratch", None):
            _remove(copy.sparkSession, path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Copies made inside are removed at the end, so results must have been written elsewhere by then."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in paths:
            _remove(spark, path)


class Sealed:
    """A DataFrame with its columns renamed to c0, c1 ..., so that no working column meets a name of the caller's."""

    def __init__(self, df: DataFrame) -> None:
        self.names = df.columns
        self.df = df.toDF(*(f"c{i}" for i in range(len(self.names))))
        self.columns = self.df.columns

    def __getitem__(self, name: str) -> Column:
        return F.col(self.names_of(name))

    def names_of(self, name: str) -> str:
        """The working name of a column of the caller's."""
        return f"c{self.names.index(name)}"

    def restored(self, df: DataFrame, **more: Column) -> DataFrame:
        """The caller's columns under their names, then ``more``; a column of the caller's named like one of them gives way."""
        taken = {m.lower() for m in more}
        kept = [F.col(c).alias(n) for c, n in zip(self.columns, self.names, strict=True) if n.lower() not in taken]
        return df.select(*kept, *(c.alias(n) for n, c in more.items()))


#: Groups with more than 1 / HEAVY of all rows are joined by broadcast; there are fewer than HEAVY of them.
HEAVY = 2000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int | None = None) -> DataFrame:
    """Left join of ``rows`` with their group's facts; ``groups`` has one row per key and ``size`` rows in each.

    Fewer than HEAVY groups can hold more than 1 / HEAVY of the rows that ``size`` counts.
    Their facts are broadcast, so a group with a third of all rows is never dealt to one
    task; rows of all other groups are shuffled by key.  ``rows`` is read twice and keys
    are not null; ``groups`` should be a written table.  ``total`` is the sum of ``size``,
    where the caller has it.
    """
    if total is None:
        total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    facts = [c for c in groups.columns if c not in keys]
    heavy = F.col(size) * HEAVY > F.lit(total)
    theirs = groups.where(heavy).withColumnsRenamed({k: f"{k}__" for k in keys})
    same = [F.col(k) == F.col(f"{k}__") for k in keys]
    marked = rows.join(F.broadcast(theirs), same, "left")
    found = marked.where(F.col(f"{keys[0]}__").isNotNull()).select(*rows.columns, *facts)
    light = groups.where(~heavy)
    rest = marked.where(F.col(f"{keys[0]}__").isNull()).select(*rows.columns).join(light, keys, "left").select(*rows.columns, *facts)
    return found.union(rest)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bytes of an Arrow batch at most, for operators that hand texts to Python.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to BATCH_BYTES, so that long texts do not add up in a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) != str(BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def sampled(rows: DataFrame, key: Column, share: float | Column) -> DataFrame:
    """The rows whose ``key`` hashes into ``share`` (0 to 1) of 2^62 steps, so that no share rounds to nothing."""
    at = F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 62)).cast("double") / F.lit(float(1 << 62))
    return rows.where(at < share)


def gapless_rank(df: DataFrame, group: str, order: list[Column], bucket: Column, name: str, facts: DataFrame | None = None) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... within ``group`` (a column that is not null), without one task per group.

    Rows of a group fall into buckets; rows are numbered inside (group, bucket)
    and lifted by the number of rows in lower buckets of the group.  Only the
    counts, one row per (group, bucket), are ever put in sequence.  ``facts`` (one row
    per group, keyed by its column ``_g``) is joined to the counts, so that its other
    columns reach the rows without a join on the group alone.
    """
    from pyspark.sql import Window

    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("_g"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_offset"),
    )
    if facts is not None:
        offsets = offsets.join(facts, "_g", "left")
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    ranked = rows.withColumn("_rn", F.row_number().over(inside).cast("long"))
    # Plain equality: the window's partitioning then serves the join as well.
    joined = ranked.join(offsets, (F.col(group) == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(name, F.col("_offset") + F.col("_rn") - 1).drop("_bucket", "_g", "_b", "_offset", "_rn")


#: Bits of a filter at least and at most: 2 MB to 8 MB, whatever the input.
FILTER_BITS, MOST_FILTER_BITS = 1 << 24, 1 << 26


def filter_bits(keys: int) -> int:
    """Bits of a filter for so many keys: eight each, rounded up to a power of two, within the bounds."""
    return min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (8 * keys).bit_length()))


def probably_in(rows: DataFrame, keys: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose long ``column`` may be among the values of the same column of ``keys``.

    A filter of ``bits`` bits in at most ``bits`` / 64 words is broadcast, so most other
    rows are left behind before a shuffle.  It never loses a row that has a match; as
    keys outgrow the largest filter, more rows without one pass.
    """
    return _marked(rows, keys, column, bits).where("__hit").drop("__hit")


def split_by_filter(rows: DataFrame, keys: DataFrame, column: str, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows that may be among ``keys`` as ``probably_in`` has them, and all other rows."""
    marked = _marked(rows, keys, column, bits)
    return marked.where("__hit").drop("__hit"), marked.where("NOT __hit").drop("__hit")


def _marked(rows: DataFrame, keys: DataFrame, column: str, bits: int) -> DataFrame:
    h = F.xxhash64(F.lit(0), F.col(column))
    word, bit = F.pmod(h, F.lit(bits // 64)).cast("int"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int")
    words = keys.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    hit = F.call_function("shiftrightunsigned", F.coalesce("__bits", F.lit(0).cast("long")), F.col("__at")).bitwiseAND(F.lit(1).cast("long")) == 1
    marked = rows.withColumns({"__w": word, "__at": bit}).join(F.broadcast(words), F.col("__w") == F.col("__word"), "left")
    return marked.withColumn("__hit", hit).drop("__w", "__at", "__word", "__bits")
