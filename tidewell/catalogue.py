"""Registered queries over the grid views of the relational test tables, each with SQL of the same result.

Cubes: shipments (lineitem), hourly event means and daily order means on dense spines,
and embeddings as series.  Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import functions, operators  # noqa: F401 - registration
from tidewell.model import GridFrame, Result, named
from tidewell.operators.directional import in_sectors
from tidewell.plans.config import Mask
from tidewell.plans.output import apply_mask, mask_frame
from tidewell.plans.pipeline import Pipeline, derive
from tidewell.registry import get_stat
from tidewell.sources.select import prepare
from tidewell.streaming import incremental, samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SHIPMENTS = """
  SELECT l_shipdate AS time, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax,
    CAST((l_partkey * 37) % 360 AS DOUBLE) AS dpm, l_quantity / 2 AS wspd, l_quantity - 25 AS uwnd, l_discount * 200 - 10 AS vwnd,
    l_quantity - 25 AS ucur, l_discount * 200 - 10 AS vcur, 0.05 + l_tax * 2.5 AS fp, l_quantity / 4 AS hs_sea, l_tax * 60 AS hs_sw1,
    l_discount * 30 AS hs_sw2, sqrt(l_quantity / 4 * (l_quantity / 4) + l_tax * 60 * (l_tax * 60)) AS hs, 4 + l_quantity / 5 AS tp,
    l_extendedprice / 300 AS lp_sw1, CAST((l_partkey * 37) % 360 AS DOUBLE) AS dir_sea, CAST((l_suppkey * 53) % 360 AS DOUBLE) AS dir_sw1,
    CAST((l_orderkey * 17) % 360 AS DOUBLE) AS dir_sw2, l_discount * 10 AS cloud_cover, CAST(1 + l_linenumber * 10 AS DOUBLE) AS depth,
    CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber
  FROM lineitem"""
CELLS = ("l_returnflag", "l_linestatus")
HOURLY = """
  SELECT s.event_type, s.time, e.value FROM (
    SELECT event_type, time FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS time)) s
  LEFT JOIN (SELECT event_type, date_trunc('hour', ts) AS time, avg(value) AS value FROM events GROUP BY 1, 2) e ON s.event_type = e.event_type AND s.time = e.time"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipments(spark: SparkSession, sf_dir: str, *variables: str) -> GridFrame:
    df = _read(spark, sf_dir, "lineitem")
    quantity, tax = F.col("l_quantity"), F.col("l_tax")

    def turned(key: str, by: int):
        return ((F.col(key) * by) % 360).cast("double")

    made = {
        "time": F.col("l_shipdate"), "dpm": turned("l_partkey", 37), "wspd": quantity / 2, "uwnd": quantity - 25, "vwnd": F.col("l_discount") * 200 - 10,
        "ucur": quantity - 25, "vcur": F.col("l_discount") * 200 - 10, "fp": 0.05 + tax * 2.5, "hs_sea": quantity / 4, "hs_sw1": tax * 60, "hs_sw2": F.col("l_discount") * 30,
        "hs": F.sqrt(quantity / 4 * (quantity / 4) + tax * 60 * (tax * 60)), "tp": 4 + quantity / 5, "lp_sw1": F.col("l_extendedprice") / 300, "dir_sea": turned("l_partkey", 37),
        "dir_sw1": turned("l_suppkey", 53), "dir_sw2": turned("l_orderkey", 17), "cloud_cover": F.col("l_discount") * 10, "depth": (1 + F.col("l_linenumber") * 10).cast("double"),
    }
    return GridFrame.of(df.withColumns(made), "time", CELLS, variables)


def hourly(spark: SparkSession, sf_dir: str) -> GridFrame:
    """Mean event value per type and hour, on a spine of all hours: a missing hour is a NULL row."""
    events = _read(spark, sf_dir, "events")
    hours = spark.range(720).select((F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("time"))
    spine = events.select("event_type").distinct().crossJoin(F.broadcast(hours))
    means = events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).agg(F.avg("value").alias("value"))
    return GridFrame.of(spine.join(means, ["event_type", "time"], "left"), "time", ("event_type",), ("value",))


def daily(spark: SparkSession, sf_dir: str) -> GridFrame:
    orders = _read(spark, sf_dir, "orders")
    days = spark.range(2405).select((F.lit("1995-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("time"))
    spine = orders.select("o_orderpriority").distinct().crossJoin(F.broadcast(days))
    means = orders.groupBy("o_orderpriority", F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("time")).agg(F.avg("o_totalprice").alias("o_totalprice"))
    return GridFrame.of(spine.join(means, ["o_orderpriority", "time"], "left"), "time", ("o_orderpriority",), ("o_totalprice",))


def vectors(spark: SparkSession, sf_dir: str) -> GridFrame:
    df = _read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("time", "x"))
    return GridFrame.of(df, "time", ("vec_id",), ("x",))


def rounded(made: Result | DataFrame, digits: int = 6) -> DataFrame:
    df = made.df if isinstance(made, Result) else made
    return df.withColumns({f.name: F.round(named(f.name).cast("double"), digits) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")})


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _stat(name: str, stat: str, variables: tuple[str, ...], select: str | None, group: str | None = None, digits: int = 6, source=shipments, **options) -> None:
    """A statistic on shipments; ``select`` are its value columns in SQL, grouped by cell and group."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = source(spark, sf_dir, *variables) if source is shipments else source(spark, sf_dir)
        return rounded(get_stat(stat)(frame, group=group, **options), digits)

    keys = {None: "", "month": ", CAST(month(time) AS INTEGER) AS month", "year": ", CAST(year(time) AS INTEGER) AS year", "season": f", {SEASON} AS season"}[group]
    sql = select and f"WITH x AS ({SHIPMENTS}) SELECT l_returnflag, l_linestatus{keys}, {select} FROM x GROUP BY ALL"
    _add(name, query, sql)


SEASON = "CASE WHEN month(time) IN (12, 1, 2) THEN 'DJF' WHEN month(time) <= 5 THEN 'MAM' WHEN month(time) <= 8 THEN 'JJA' ELSE 'SON' END"
BOTH = ("l_quantity", "l_discount")


def _each(sql: str, variables: tuple[str, ...] = BOTH) -> str:
    return ", ".join(f"{sql.format(v=v)} AS {v}" for v in variables)


_stat("mean", "mean", BOTH, _each("round(avg({v}), 6)"))
_stat("max", "max", BOTH, _each("round(max({v}), 6)"))
_stat("min", "min", BOTH, _each("round(min({v}), 6)"))
_stat("std", "std", BOTH, _each("round(stddev_pop({v}), 6)"))
_stat("std_ddof1", "std", BOTH, _each("round(stddev_samp({v}), 6)"), ddof=1)
_stat("count", "count", BOTH, _each("count({v})"))
_stat("pcount", "pcount", BOTH, _each("round(100.0 * count({v}) / count(*), 6)"))
_stat("mean_month", "mean", ("l_quantity", "l_extendedprice"), "round(avg(l_quantity), 3) AS l_quantity, round(avg(l_extendedprice), 3) AS l_extendedprice", "month", digits=3)
_stat("max_season", "max", BOTH, _each("round(max({v}), 6)"), "season")
_stat("min_year", "min", BOTH, _each("round(min({v}), 6)"), "year")
_stat("std_year", "std", BOTH, _each("round(stddev_pop({v}), 6)"), "year")
_stat("count_month", "count", BOTH, _each("count({v})"), "month")
_stat("pcount_month", "pcount", BOTH, _each("round(100.0 * count({v}) / count(*), 6)"), "month")
Q = (0.05, 0.5, 0.95)
for _name, _group in (("quantile", None), ("quantile_month", "month")):
    _key = ", CAST(month(time) AS INTEGER) AS month" if _group else ""
    _stat(_name, "quantile", BOTH, None, _group, q=Q)
    _add(_name, QUERIES[_name], f"WITH x AS ({SHIPMENTS}) " + " UNION ALL ".join(
        f"SELECT l_returnflag, l_linestatus{_key}, CAST({q} AS DOUBLE) AS quantile, " + _each(f"round(quantile_cont({{v}}, {q}), 6)") + " FROM x GROUP BY ALL" for q in Q))


def _bin(v: str, edges: list[float]) -> str:
    last = len(edges) - 2
    return "CASE " + " ".join(f"WHEN {v} >= {a} AND {v} <{'=' if k == last else ''} {b} THEN {k}" for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))) + " END"


def _mid(k: str, edges: list[float]) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN CAST({(a + b) / 2} AS DOUBLE)" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))) + " END"


TENS = [float(x) for x in range(0, 61, 10)]
for _name, _weight, _group in (("mode", None, None), ("mode_weighted", "l_tax", None), ("mode_month", None, "month")):
    _key = ", CAST(month(time) AS INTEGER) AS month" if _group else ""
    _by = ", month" if _group else ""
    _stat(_name, "mode", ("l_quantity",), None, _group, bins={"start": 0, "stop": 50, "step": 10}, weight_var=_weight)
    _add(_name, QUERIES[_name], f"""
WITH x AS ({SHIPMENTS}), b AS (SELECT l_returnflag, l_linestatus{_key}, {_bin('l_quantity', TENS[:-1])} AS b, round(sum({_weight or 1.0}), 6) AS w FROM x WHERE {_weight or 1} IS NOT NULL GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus{_by} ORDER BY w DESC, b) AS n FROM b WHERE b IS NOT NULL)
SELECT l_returnflag, l_linestatus{_by}, {_mid('b', TENS[:-1])} AS l_quantity FROM r WHERE n = 1""")  # fmt: skip

_stat("exceedance", "exceedance", ("l_quantity", "wspd"), "round(avg(CASE WHEN l_quantity >= 20 THEN 1.0 ELSE 0.0 END), 6) AS l_quantity_20, round(avg(CASE WHEN wspd >= 20 THEN 1.0 ELSE 0.0 END), 6) AS wspd_20", threshold=20)
_stat("exceedance_maxval", "exceedance", ("l_quantity",), "round(avg(CASE WHEN l_quantity > 10 AND l_quantity <= 30 THEN 1.0 ELSE 0.0 END), 6) AS l_quantity_10", threshold=10, maxval=30, inclusive=False)
_stat("exceedance_month", "exceedance", ("l_quantity",), "round(avg(CASE WHEN l_quantity >= 25 THEN 1.0 ELSE 0.0 END), 6) AS l_quantity_25", "month", threshold=25)
_stat("nonexceedance", "nonexceedance", ("l_quantity",), "round(avg(CASE WHEN l_quantity <= 25 THEN 1.0 ELSE 0.0 END), 6) AS l_quantity_25", threshold=25)
_stat(
    "range_probability", "range_probability", BOTH,
    "round(avg(CASE WHEN l_quantity >= 10 AND l_quantity < 20 THEN 1.0 ELSE 0.0 END), 6) AS l_quantity_10_to_20, round(avg(CASE WHEN l_quantity <= 5 THEN 1.0 ELSE 0.0 END), 6) AS l_quantity_min_to_5, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS large",
    data_ranges=[{"var": "l_quantity", "start": 10, "stop": 20, "right": "open"}, {"var": "l_quantity", "stop": 5}, {"var": "l_discount", "start": 0.05, "left": "open", "label": "large"}],
)


def _persistence(op: str, dur_hours: list[float], labels: list[str], key: str = "") -> str:
    """Share of samples in runs of ``value op``; runs at the ends of the record do not count."""
    parts = " UNION ALL ".join(
        f"""SELECT event_type{", month" if key else ""}{f", '{label}' AS duration" if len(labels) > 1 else ""},
  round(avg(CASE WHEN c AND a > 1 AND b < n AND len >= {h} THEN 1.0 ELSE 0.0 END), 6) AS value_{op.split()[1]} FROM runs GROUP BY ALL"""
        for h, label in zip(dur_hours, labels, strict=True)
    )
    return f"""
WITH x AS ({HOURLY}), c AS (SELECT event_type, time{key}, coalesce(value {op}, false) AS c FROM x),
  i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY time) AS i, row_number() OVER (PARTITION BY event_type, c ORDER BY time) AS j, count(*) OVER (PARTITION BY event_type) AS n FROM c),
  runs AS (SELECT *, count(*) OVER w AS len, min(i) OVER w AS a, max(i) OVER w AS b FROM i WINDOW w AS (PARTITION BY event_type, c, i - j))
{parts}"""


def _hourly(name: str, stat: str, sql: str | None, group: str | None = None, **options) -> None:
    _stat(name, stat, (), None, group, source=hourly, **options)
    _add(name, QUERIES[name], sql)


_hourly("exceedance_duration", "exceedance", _persistence(">= 40", [3], ["3h"]), threshold=40, duration="3h")
_hourly("exceedance_durations", "exceedance", _persistence(">= 40", [2, 4, 8], ["2h", "4h", "8h"]), threshold=40, duration=["2h", "4h", "8h"])
_hourly("nonexceedance_duration", "nonexceedance", _persistence("<= 60", [3], ["3h"]), threshold=60, duration="3h")
_hourly("exceedance_duration_month", "exceedance", _persistence(">= 40", [3], ["3h"], ", CAST(month(time) AS INTEGER) AS month"), "month", threshold=40, duration="3h")


def _dense(out: str, names: list[str], bins: list[list[float]], isdir: list[bool], key: str = "") -> str:
    group = ", month" if key else ""
    values = [f"CASE WHEN {v} > {e[-1]} THEN {v} - 360 ELSE {v} END" if d else v for v, e, d in zip(names, bins, isdir, strict=True)]
    cols = ", ".join(f"{_bin(f'({x})', e)} AS k{i}" for i, (x, e) in enumerate(zip(values, bins, strict=True)))
    spine = " ".join(f"CROSS JOIN (SELECT unnest(range({len(e) - 1})) AS k{i}) s{i}" for i, e in enumerate(bins))
    ks = ", ".join(f"k{i}" for i in range(len(bins)))
    return f"""
WITH x AS ({SHIPMENTS}), b AS (SELECT l_returnflag, l_linestatus{key}, {cols} FROM x), n AS (SELECT l_returnflag, l_linestatus{group}, {ks}, count(*) AS n FROM b GROUP BY ALL),
  s AS (SELECT * FROM (SELECT DISTINCT l_returnflag, l_linestatus{group} FROM b) {spine})
SELECT s.l_returnflag, s.l_linestatus{", s.month" if key else ""}, {", ".join(f"{_mid(f's.k{i}', e)} AS {v}" for i, (v, e) in enumerate(zip(names, bins, strict=True)))}, CAST(coalesce(n.n, 0) AS DOUBLE) AS {out}
FROM s LEFT JOIN n ON s.l_returnflag = n.l_returnflag AND s.l_linestatus = n.l_linestatus{" AND s.month = n.month" if key else ""} AND {" AND ".join(f"s.k{i} = n.k{i}" for i in range(len(bins)))}"""


W, D = [0.0, 5.0, 10.0, 15.0, 20.0, 25.0], [-45.0, 45.0, 135.0, 225.0, 315.0]
H, T = [0.0, 4.0, 8.0, 16.0], [4.0, 8.0, 12.0, 14.0]
_MONTH = ", CAST(month(time) AS INTEGER) AS month"
_stat("distribution2", "distribution2", ("wspd", "dpm"), None, var2="dpm", bins1=W, bins2=D)
_add("distribution2", QUERIES["distribution2"], _dense("dist2", ["wspd", "dpm"], [W, D], [False, True]))
_stat("distribution2_month", "distribution2", ("wspd", "dpm"), None, "month", var2="dpm", bins1=W, bins2=D)
_add("distribution2_month", QUERIES["distribution2_month"], _dense("dist2", ["wspd", "dpm"], [W, D], [False, True], _MONTH))
for _name, _stat_name, _group in (("distribution3", "distribution3", None), ("distribution3_month", "distribution3", "month"), ("distribution3_timestep", "distribution3_timestep", None)):
    _stat(_name, _stat_name, ("hs", "tp", "dpm"), None, _group, bins1=H, bins2=T, bins3=D)
    _add(_name, QUERIES[_name], _dense("dist", ["hs", "tp", "dpm"], [H, T, D], [False, False, True], _MONTH if _group else ""))

SECTOR = "CASE WHEN dpm >= 45 AND dpm < 315 THEN CAST(floor((dpm + 45) / 90) AS INTEGER) ELSE 0 END"


def _sectors(select: str) -> str:
    parts = " UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, CAST({i * 90} AS DOUBLE) AS direction, {select.format(s=i)} FROM y GROUP BY ALL" for i in range(4))
    return f"WITH x AS ({SHIPMENTS}), y AS (SELECT *, {SECTOR} AS sec FROM x) {parts}"


def _sector_query(name: str, stat: str, sql: str, **options) -> None:
    _add(name, lambda spark, sf: rounded(in_sectors(shipments(spark, sf, "l_quantity", "dpm").pick(["l_quantity"], ["dpm"]), get_stat(stat), None, "dpm", 4, **options)), sql)


_sector_query("nsector_mean", "mean", _sectors("round(avg(CASE WHEN sec = {s} THEN l_quantity END), 6) AS l_quantity"))
_sector_query("nsector_exceedance", "exceedance", _sectors("round(avg(CASE WHEN sec = {s} AND l_quantity >= 25 THEN 1.0 ELSE 0.0 END), 6) AS l_quantity_25"), threshold=25)
_sector_query("nsector_quantile", "quantile", _sectors("CAST(0.5 AS DOUBLE) AS quantile, round(quantile_cont(CASE WHEN sec = {s} THEN l_quantity END, 0.5), 6) AS l_quantity"), q=[0.5])
_add(
    "statdir",
    lambda spark, sf: rounded(get_stat("statdir")(shipments(spark, sf, "l_quantity", "dpm"), funcs=["mean", "max", "count"], dir_var="dpm", nsector=4)),
    _sectors("round(avg(CASE WHEN sec = {s} THEN l_quantity END), 6) AS l_quantity_mean, max(CASE WHEN sec = {s} THEN l_quantity END) AS l_quantity_max, count(CASE WHEN sec = {s} THEN l_quantity END) AS l_quantity_count"),
)


def _modal(weight: str, smooth: bool, key: str = "") -> str:
    by = f"l_returnflag, l_linestatus{', month' if key else ''}"
    h = "(lag_h + h + lead_h) / 3" if smooth else "h"
    return f"""
WITH x AS ({SHIPMENTS}), w AS (SELECT l_returnflag, l_linestatus{key}, CAST(floor(dpm / 30) AS INTEGER) AS b, sum({weight}) AS h FROM x GROUP BY ALL),
  s AS (SELECT * FROM (SELECT DISTINCT {by} FROM w) CROSS JOIN (SELECT unnest(range(12)) AS b)),
  d AS (SELECT {by}, b, round(coalesce(h, 0.0), 6) AS h FROM s LEFT JOIN w USING ({by}, b)),
  e AS (SELECT p.*, q.h AS lag_h, r.h AS lead_h FROM d p JOIN d q USING ({by}) JOIN d r USING ({by}) WHERE q.b = (p.b + 11) % 12 AND r.b = (p.b + 1) % 12),
  f AS (SELECT {by}, b, row_number() OVER (PARTITION BY {by} ORDER BY round({h}, 6) DESC, b) AS n FROM e)
SELECT {by}, CAST((b + 0.5) * 30 AS DOUBLE) AS dpm FROM f WHERE n = 1"""


_stat("modal_direction", "modal_direction", ("dpm",), None, bin_width_deg=30)
_add("modal_direction", QUERIES["modal_direction"], _modal("1.0", True))
_stat("modal_direction_raw", "modal_direction", ("dpm",), None, bin_width_deg=30, smooth=False)
_add("modal_direction_raw", QUERIES["modal_direction_raw"], _modal("1.0", False))
_stat("modal_direction_weighted", "modal_direction", ("dpm",), None, bin_width_deg=30, weight_var="l_quantity")
_add("modal_direction_weighted", QUERIES["modal_direction_weighted"], _modal("l_quantity", True))
_stat("modal_direction_month", "modal_direction", ("dpm",), None, "month", bin_width_deg=30)
_add("modal_direction_month", QUERIES["modal_direction_month"], _modal("1.0", True, _MONTH))

# The cubic is the least squares fit to the reference power curve.
POWER = "CASE WHEN {v} IS NULL OR {v} >= 25 THEN 0.0 WHEN {v} >= 10.61 THEN 16000.0 WHEN {v} > 3 THEN -5508.279052597661 * {v} + 1120.2416340159753 * {v} * {v} - 51.11541588538239 * {v} * {v} * {v} + 9514.910653953144 ELSE 0.0 END"
_stat("winpow_mean", "winpow", ("wspd",), f"round(avg({POWER.format(v='wspd')}), 3) AS wspd", digits=3)
_stat("winpow_month", "winpow", ("wspd",), f"round(max({POWER.format(v='wspd')}), 3) AS wspd", "month", digits=3, agg="max")


def _winpow_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = GridFrame.of(shipments(spark, sf_dir, "wspd").df, "time", ("l_orderkey", "l_linenumber"), ("wspd",))
    return rounded(get_stat("winpow")(grid, agg=None).df.drop("time"), 3)


_add("winpow_series", _winpow_series, f"WITH x AS ({SHIPMENTS}) SELECT l_orderkey, l_linenumber, round({POWER.format(v='wspd')}, 3) AS wspd FROM x")

UORB = "CASE WHEN depth > 0 THEN {h} END"


def _wavenumber(depth: str = "depth") -> str:
    x = f"(4 * pi() * pi() / (tp * tp) * {depth} / 9.81)"
    return f"({x} * sqrt(1 + 1 / ({x} * (1 + 0.6522 * {x} + 0.4622 * pow({x}, 2) + 0.0864 * pow({x}, 4) + 0.0675 * pow({x}, 5)))) / {depth})"


def _orbital(z: str) -> str:
    return f"round(avg(pi() * hs / tp * (exp(k * ({z}) - k * depth) + exp(-k * ({z}) - k * depth)) / (1 - exp(-2 * k * depth))), 4)"


DERIVED = {
    "wspd": ({"func": "wspd"}, "sqrt(uwnd * uwnd + vwnd * vwnd)"),
    "wdir": ({"func": "wdir"}, "((270 - degrees(atan2(vwnd, uwnd))) % 360 + 360) % 360"),
    "cspd": ({"func": "cspd"}, "sqrt(ucur * ucur + vcur * vcur)"),
    "cdir": ({"func": "cdir"}, "((90 - degrees(atan2(vcur, ucur))) % 360 + 360) % 360"),
    "tp": ({"func": "tp"}, "1 / fp"),
    "douglas_sea": ({"func": "douglas_sea"}, "CASE WHEN hs_sea <= 0 THEN 0.0 WHEN hs_sea <= 0.1 THEN 1.0 WHEN hs_sea <= 0.5 THEN 2.0 WHEN hs_sea <= 1.25 THEN 3.0 WHEN hs_sea <= 2.5 THEN 4.0 WHEN hs_sea <= 4 THEN 5.0 WHEN hs_sea <= 6 THEN 6.0 WHEN hs_sea <= 9 THEN 7.0 WHEN hs_sea <= 14 THEN 8.0 ELSE 9.0 END"),
    "douglas_swell": ({"func": "douglas_swell"}, "CASE WHEN hs_sw1 <= 0 OR lp_sw1 <= 0 THEN 0.0 WHEN hs_sw1 <= 2 THEN CASE WHEN lp_sw1 <= 200 THEN 1.0 ELSE 2.0 END WHEN hs_sw1 <= 4 THEN CASE WHEN lp_sw1 <= 100 THEN 3.0 WHEN lp_sw1 <= 200 THEN 4.0 ELSE 5.0 END ELSE CASE WHEN lp_sw1 <= 100 THEN 6.0 WHEN lp_sw1 <= 200 THEN 7.0 ELSE 8.0 END END"),
    "crossing_seas": ({"func": "crossing_seas"}, "CASE WHEN {c1} THEN 1.0 ELSE 0.0 END"),
    "crossing_seas_sw2": ({"func": "crossing_seas", "hs_sw2": "hs_sw2", "dir_sw2": "dir_sw2"}, "CASE WHEN {c1} OR {c2} OR {c3} THEN 1.0 ELSE 0.0 END"),
    "clear_sky": ({"func": "clear_sky", "cover_threshold": 0.2}, "CASE WHEN cloud_cover <= 0.2 THEN 1.0 ELSE 0.0 END"),
    "covered_sky": ({"func": "covered_sky", "cover_threshold": 0.8}, "CASE WHEN cloud_cover >= 0.8 THEN 1.0 ELSE 0.0 END"),
}
_FLOOR = "(hs > 0.5 AND {a} > sqrt(0.2) * hs AND {b} > sqrt(0.2) * hs AND abs(((({d} - {e} + 180) % 360) + 360) % 360 - 180) > 40)"
_CROSS = {
    "c1": _FLOOR.format(a="hs_sea", b="hs_sw1", d="dir_sea", e="dir_sw1"),
    "c2": _FLOOR.format(a="hs_sea", b="hs_sw2", d="dir_sea", e="dir_sw2"),
    "c3": _FLOOR.format(a="hs_sw1", b="hs_sw2", d="dir_sw1", e="dir_sw2"),
}
_INPUTS = ("uwnd", "vwnd", "ucur", "vcur", "fp", "hs", "hs_sea", "hs_sw1", "hs_sw2", "dir_sea", "dir_sw1", "dir_sw2", "lp_sw1", "cloud_cover", "depth", "tp")


def _derived(name: str, spec: dict, sql: str, digits: int = 6) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = derive(shipments(spark, sf_dir, *_INPUTS), [dict(name="made", **spec)])
        return rounded(get_stat("mean")(frame.pick(["made"])), digits)

    _add(f"derived_{name}", query, f"WITH x AS ({SHIPMENTS}) SELECT l_returnflag, l_linestatus, {sql} AS made FROM x GROUP BY ALL")


for _name, (_spec, _sql) in DERIVED.items():
    _derived(_name, _spec, f"round(avg({_sql.format(**_CROSS)}), 6)")
for _name, _spec, _z in (("uorb", {}, "0.0"), ("uorb_z", {"z": 0.5}, "0.5"), ("uorb_surface", {"reference": "surface", "z": 1.0}, "depth - 1.0")):
    _derived(_name, {"func": "uorb", **_spec}, "", 4)
    _add(f"derived_{_name}", QUERIES[f"derived_{_name}"], f"WITH x AS ({SHIPMENTS}), y AS (SELECT *, {_wavenumber()} AS k FROM x WHERE depth > 0) SELECT l_returnflag, l_linestatus, {_orbital(_z)} AS made FROM y GROUP BY ALL")
_newton = "list_reduce(list_prepend(4 * pi() * pi() / (tp * tp) / 9.81, list_transform(range(50), lambda i: 0.0::DOUBLE)), lambda k, i: k - (4 * pi() * pi() / (tp * tp) - 9.81 * k * tanh(k * depth)) / (-9.81 * (tanh(k * depth) + k * depth / pow(cosh(k * depth), 2))))"
_derived("uorb_exact", {"func": "uorb", "solver": "exact"}, "", 4)
_add("derived_uorb_exact", QUERIES["derived_uorb_exact"], f"WITH x AS ({SHIPMENTS}), u AS (SELECT DISTINCT tp, depth FROM x), v AS (SELECT tp, depth, {_newton} AS k FROM u), y AS (SELECT x.*, v.k FROM x JOIN v ON x.tp = v.tp AND x.depth = v.depth) SELECT l_returnflag, l_linestatus, {_orbital('0.0')} AS made FROM y GROUP BY ALL")


def _selected(name: str, sql: str, variables: tuple[str, ...] = ("l_quantity",), **given) -> None:
    """Mean of a selection; selections are over the cube's columns before roles are told."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = prepare(shipments(spark, sf_dir, "l_quantity").df.select("time", *CELLS, "l_quantity"), **given)
        grid = GridFrame.of(df, "time", [c for c in CELLS if c in df.columns], variables)
        return rounded(get_stat("mean")(grid))

    _add(name, query, f"WITH x AS ({SHIPMENTS}) {sql}")


_MEAN = "round(avg(l_quantity), 6) AS l_quantity FROM x"
_selected("sel_range", f"SELECT l_returnflag, l_linestatus, {_MEAN} WHERE time >= TIMESTAMP '1996-01-01' AND time < TIMESTAMP '1997-01-01' GROUP BY ALL", sel={"time": {"start": "1996-01-01", "stop": "1996-12-31"}})
_selected("sel_list", f"SELECT l_returnflag, l_linestatus, {_MEAN} WHERE l_returnflag IN ('A', 'R') GROUP BY ALL", sel={"l_returnflag": ["A", "R"]})
_selected("sel_scalar", f"SELECT l_linestatus, {_MEAN} WHERE l_returnflag = 'A' GROUP BY ALL", sel={"l_returnflag": "A"})
_selected("sel_nearest", f"SELECT l_returnflag, l_linestatus, {_MEAN} WHERE time = (SELECT arg_min(time, abs(epoch(time) - epoch(TIMESTAMP '1998-06-01 07:00:00'))) FROM x) GROUP BY ALL", sel={"time": ["1998-06-01 07:00:00"], "method": "nearest"})
_selected("isel_range", f"SELECT l_returnflag, l_linestatus, {_MEAN} WHERE l_returnflag IN (SELECT DISTINCT l_returnflag FROM x ORDER BY 1 LIMIT 2) GROUP BY ALL", isel={"l_returnflag": {"start": 0, "stop": 2}})
_selected("isel_scalar", f"SELECT l_linestatus, {_MEAN} WHERE l_returnflag = (SELECT max(l_returnflag) FROM x) GROUP BY ALL", isel={"l_returnflag": -1})
_selected("mapping", f"SELECT l_returnflag, l_linestatus, {_MEAN.replace('AS l_quantity', 'AS hs')} GROUP BY ALL", ("hs",), mapping={"l_quantity": "hs", "absent": "x"})


def _masked(name: str, mask: dict, keep: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        grid = shipments(spark, sf_dir, "l_quantity", "l_tax")
        counts = get_stat("max")(grid.pick(["l_quantity"]))
        return rounded(apply_mask(counts, *mask_frame(grid.df, Mask(**mask), list(CELLS))))

    _add(name, query, f"WITH x AS ({SHIPMENTS}) SELECT l_returnflag, l_linestatus, CASE WHEN {keep} THEN max(l_quantity) END AS l_quantity FROM x GROUP BY ALL")


_masked("mask_notnull", {"type": "notnull", "var": "l_tax"}, "count(l_tax) > 0")
_masked("mask_threshold", {"type": "threshold", "var": "l_extendedprice", "operator": "gt", "value": 1000.0}, "max(l_extendedprice) > 1000")


def _pipeline_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared pipeline: three plain statistics of one source run as one aggregation."""
    made = Pipeline(
        {
            "source": {"type": "xarray", "urlpath": f"{sf_dir}/lineitem.parquet", "engine": "parquet", "mapping": {"l_shipdate": "time", "l_quantity": "hs"}, "cells": list(CELLS)},
            "output": {"outfile": "never-written.zarr"},
            "calls": [{"func": "mean", "data_vars": ["hs"]}, {"func": "max", "data_vars": ["hs"]}, {"func": "exceedance", "data_vars": ["hs"], "threshold": 25}],
        },
        spark,
    ).compute()[0]
    return rounded(made[CELLS].df)


_add("pipeline_calls", _pipeline_calls, f"WITH x AS ({SHIPMENTS}) SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS hs_mean, max(l_quantity) AS hs_max, round(avg(CASE WHEN l_quantity >= 25 THEN 1.0 ELSE 0.0 END), 6) AS hs_25_exceedance FROM x GROUP BY ALL")


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregation on a bounded input: means per type and ten-day window."""
    events = samples(_read(spark, sf_dir, "events").withColumnRenamed("ts", "time"))
    grid = GridFrame.of(events, "time", ("event_type",), ("value",))
    out = incremental(grid, {"mean": {}, "count": {}}, window="10 days")
    return rounded(out.select("event_type", F.unix_seconds("window.start").alias("start"), "value_mean", "value_count"))


_add("incremental_window", _windowed, "SELECT event_type, CAST(floor(epoch(ts) / 864000) AS BIGINT) * 864000 AS start, round(avg(value), 6) AS value_mean, count(value) AS value_count FROM events GROUP BY ALL")


def _rpv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(get_stat("rpv")(daily(spark, sf_dir), return_periods=[1, 10, 100], percentile=90, duration=72), 3)


def _hmo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(get_stat("hmo")(vectors(spark, sf_dir), segsec=32, fs=1.0, bands={"low": [None, 0.25], "tot": [None, None]}))


# Peaks over the 90th percentile, thinned from the highest down to 3 days apart; a Gumbel fit by bisection; its upper tail.
_add("rpv", _rpv, """
WITH RECURSIVE d AS (SELECT o_orderpriority AS g, date_trunc('day', o_orderdate) AS t, avg(o_totalprice) AS x FROM orders GROUP BY ALL),
  o AS (SELECT g, x, row_number() OVER w - 1 AS i, lag(x) OVER w AS a, lead(x) OVER w AS b, quantile_cont(x, 0.9) OVER (PARTITION BY g) AS h FROM d WINDOW w AS (PARTITION BY g ORDER BY t)),
  p AS (SELECT g, i, x, row_number() OVER (PARTITION BY g ORDER BY x DESC, i DESC) AS r FROM o WHERE x > a AND x > b AND x >= h),
  k AS (SELECT DISTINCT g, 0::BIGINT AS r, []::BIGINT[] AS kept, []::DOUBLE[] AS y FROM d
    UNION ALL SELECT k.g, p.r, CASE WHEN len(list_filter(kept, lambda q: abs(q - p.i) < 3)) = 0 THEN list_append(kept, p.i) ELSE kept END,
      CASE WHEN len(list_filter(kept, lambda q: abs(q - p.i) < 3)) = 0 THEN list_append(y, p.x) ELSE y END FROM k JOIN p ON p.g = k.g AND p.r = k.r + 1),
  f AS (SELECT g, arg_max(y, r) AS y FROM k GROUP BY g),
  s AS (SELECT g, y, len(y) AS m, list_min(y) AS low, list_avg(y) AS mean, list_aggregate(y, 'stddev_pop') AS sd, (SELECT count(*) FROM d WHERE d.g = f.g) * 24 / 8760.0::DOUBLE AS years FROM f),
  b AS (SELECT g, 0 AS n, sd * 1e-3::DOUBLE AS lo, sd * 10 AS hi FROM s WHERE m > 1
    UNION ALL SELECT g, n + 1, CASE WHEN gap > 0 THEN mid ELSE lo END, CASE WHEN gap > 0 THEN hi ELSE mid END FROM (
      SELECT b.g, n, lo, hi, (lo + hi) / 2 AS mid, mean - list_sum(list_transform(y, lambda v: v * exp(-(v - low) / ((lo + hi) / 2)))) / list_sum(list_transform(y, lambda v: exp(-(v - low) / ((lo + hi) / 2)))) - (lo + hi) / 2 AS gap
      FROM b JOIN s ON s.g = b.g WHERE n < 200)),
  e AS (SELECT s.*, (lo + hi) / 2 AS scale FROM s LEFT JOIN b ON b.g = s.g AND b.n = 200),
  l AS (SELECT *, low - scale * ln(list_avg(list_transform(y, lambda v: exp(-(v - low) / scale)))) AS loc FROM e)
SELECT g AS o_orderpriority, period::DOUBLE AS period, round(loc - scale * ln(-ln(1 - least(years / (period * m), 1))), 3) AS o_totalprice FROM l, (VALUES (1), (10), (100)) AS t(period)
""")
# Half-overlapping Hann segments of 32, a discrete Fourier transform written out, Simpson's rule over 8 and 16 steps of 1/32.
_add("hmo", _hmo, """
WITH v AS (SELECT vec_id, len(embedding) AS n, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings),
  s AS (SELECT vec_id, s, t - 16 * s AS i, (x - avg(x) OVER (PARTITION BY vec_id, s)) * (0.5 - 0.5 * cos(2 * pi() * (t - 16 * s) / 32)) AS x FROM v, range(0, 100) AS r(s) WHERE t BETWEEN 16 * s AND 16 * s + 31 AND 16 * s + 32 <= n),
  f AS (SELECT vec_id, s, k, pow(sum(x * cos(2 * pi() * k * i / 32)), 2) + pow(sum(x * sin(2 * pi() * k * i / 32)), 2) AS p FROM s, range(0, 17) AS q(k) GROUP BY ALL),
  d AS (SELECT vec_id, k, avg(p) / 12 * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END AS p FROM f GROUP BY vec_id, k),
  b AS (SELECT * FROM (VALUES ('low', 8), ('tot', 16)) AS t(band, top))
SELECT vec_id, band, round(4 * sqrt(sum(p * CASE WHEN k IN (0, top) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) / 96), 6) AS hs_x FROM d JOIN b ON k <= top GROUP BY vec_id, band
""")
