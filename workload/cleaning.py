"""Cleaning steps over events, orders and lineitem."""

from pyspark.sql import functions as F

from tidewell.operators import columns, duplicates, missing, outliers
from tidewell.operators.resample import ohlcv_bars, resample
from tidewell.operators.steps import clean
from tidewell.plans import chunking, jobs
from tidewell.session import work_path, written
from workload.registry import EVENTS, GAPPY, events, gappy, query, r, rounded, table

ORDER = ["ts", "event_id"]
SERIES = ["event_type"]


@query("drop_na_any", f"WITH {GAPPY} SELECT event_id, v FROM g WHERE v IS NOT NULL")
def drop_na_any(spark, sf):
    return missing.drop_missing(gappy(spark, sf).select("event_id", "v"))


@query(
    "drop_na_all",
    f"WITH {GAPPY}, w AS (SELECT event_id, v, CASE WHEN k < 50 THEN k END AS low FROM g) "
    "SELECT * FROM w WHERE v IS NOT NULL OR low IS NOT NULL",
)
def drop_na_all(spark, sf):
    w = gappy(spark, sf).select("event_id", "v", F.when(F.col("k") < 50, F.col("k")).alias("low"))
    return missing.drop_missing(w, ["v", "low"], "all")


@query("fill_value", f"WITH {GAPPY} SELECT event_id, coalesce(v, -1) AS v FROM g")
def fill_value(spark, sf):
    return missing.fill_value(gappy(spark, sf).select("event_id", "v"), -1.0, ["v"])


@query("fill_mean", f"WITH {GAPPY} SELECT event_id, {r('coalesce(v, (SELECT avg(v) FROM g))')} AS v FROM g")
def fill_mean(spark, sf):
    return missing.fill_mean(gappy(spark, sf).select("event_id", "v"), ["v"]).withColumn("v", rounded("v"))


@query("fill_median", f"WITH {GAPPY} SELECT event_id, {r('coalesce(v, (SELECT median(v) FROM g))')} AS v FROM g")
def fill_median(spark, sf):
    return missing.fill_median(gappy(spark, sf).select("event_id", "v"), ["v"]).withColumn("v", rounded("v"))


@query(
    "fill_mode",
    f"WITH {GAPPY}, top AS (SELECT v FROM g WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1) "
    "SELECT event_id, coalesce(v, (SELECT v FROM top)) AS v FROM g",
)
def fill_mode(spark, sf):
    return missing.fill_mode(gappy(spark, sf).select("event_id", "v"), ["v"])


def _fill_sql(function: str, over: str) -> str:
    return f"WITH {GAPPY} SELECT event_id, event_type, {function}(v IGNORE NULLS) OVER ({over}) AS v FROM g"


_FORWARD = "ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_BACKWARD = "ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


def _filled(spark, sf, by, backward=False):
    rows = gappy(spark, sf).select("event_id", "ts", "event_type", "v")
    return missing.fill_along(rows, ORDER, by, ["v"], backward).drop("ts")


@query("ffill_by_series", _fill_sql("last_value", f"PARTITION BY event_type {_FORWARD}"))
def ffill_by_series(spark, sf):
    return _filled(spark, sf, SERIES)


@query("bfill_by_series", _fill_sql("first_value", f"PARTITION BY event_type {_BACKWARD}"))
def bfill_by_series(spark, sf):
    return _filled(spark, sf, SERIES, True)


@query("ffill_whole_table", _fill_sql("last_value", _FORWARD))
def ffill_whole_table(spark, sf):
    return _filled(spark, sf, [])


_PARTS = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_ROWS_PER_CHUNK = 500
_SPARSE = (
    "WITH d AS (SELECT DISTINCT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, "
    "CASE WHEN l_quantity >= 30 THEN l_quantity END AS v FROM lineitem) "
)
_BY_SHIPDATE = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, v"


def _shipments(spark, sf):
    """Many rows share a date, so that chunks are cut along the order within it."""
    v = F.when(F.col("l_quantity") >= 30, F.col("l_quantity")).alias("v")
    rows = table(spark, sf, "lineitem").select(*_PARTS, "l_returnflag", v).distinct()
    rows = written(rows, "shipments")  # the cut points and the chunks read them several times
    return rows, chunking.chunk_bounds(rows, _PARTS, _ROWS_PER_CHUNK)


@query(
    "ffill_chunked",
    _SPARSE + f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, last_value(v IGNORE NULLS) OVER ({_BY_SHIPDATE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM d",
)
def ffill_chunked(spark, sf):
    rows, bounds = _shipments(spark, sf)
    filled = missing.fill_along(rows.withColumn("w", F.col("v")), [*_PARTS, "v"], [], ["w"], bounds=bounds)
    return filled.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("w").alias("v"))


@query(
    "row_positions_chunked",
    _SPARSE + f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_returnflag {_BY_SHIPDATE}) AS position FROM d",
)
def row_positions_chunked(spark, sf):
    rows, bounds = _shipments(spark, sf)
    placed = chunking.row_positions(rows, [*_PARTS, "v"], ["l_returnflag"], bounds=bounds)
    return placed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "position")


def _dedup_sql(condition: str) -> str:
    return (
        "WITH d AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber) AS a, "
        "row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC) AS z, "
        "count(*) OVER (PARTITION BY l_suppkey, l_shipdate) AS n "
        "FROM (SELECT DISTINCT l_suppkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem)) "
        f"SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber FROM d WHERE {condition}"
    )


def _deduped(spark, sf, keep):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    distinct = duplicates.remove_duplicates(rows)
    return duplicates.remove_duplicates(
        distinct, ["l_suppkey", "l_shipdate"], keep, ["l_orderkey", "l_linenumber"]
    )


@query("dedup_first", _dedup_sql("a = 1"))
def dedup_first(spark, sf):
    return _deduped(spark, sf, "first")


@query("dedup_last", _dedup_sql("z = 1"))
def dedup_last(spark, sf):
    return _deduped(spark, sf, "last")


@query("dedup_none", _dedup_sql("n = 1"))
def dedup_none(spark, sf):
    return _deduped(spark, sf, False)


def _iqr_cte(name: str, source: str, column: str) -> str:
    return (
        f"{name} AS (SELECT * FROM {source} WHERE {column} BETWEEN "
        f"(SELECT quantile_cont({column}, 0.25) - 1.5 * (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) FROM {source}) AND "
        f"(SELECT quantile_cont({column}, 0.75) + 1.5 * (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) FROM {source}))"
    )


@query("outliers_iqr", f"WITH {GAPPY}, a AS (SELECT event_id, v FROM g), {_iqr_cte('b', 'a', 'v')} SELECT * FROM b")
def outliers_iqr(spark, sf):
    return outliers.remove_outliers_iqr(gappy(spark, sf).select("event_id", "v"), ["v"])


@query(
    "outliers_iqr_two_columns",
    "WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_extendedprice * l_discount AS cut FROM lineitem), "
    f"{_iqr_cte('b', 'a', 'l_extendedprice')}, {_iqr_cte('c', 'b', 'cut')} SELECT l_orderkey, l_linenumber, l_quantity FROM c",
)
def outliers_iqr_two_columns(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        (F.col("l_extendedprice") * F.col("l_discount")).alias("cut"),
    )
    kept = outliers.remove_outliers_iqr(rows, ["l_extendedprice", "cut"])
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "outliers_zscore",
    "WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS d FROM customer) "
    "SELECT c_custkey, c_acctbal FROM customer, s WHERE abs((c_acctbal - m) / d) < 1.5",
)
def outliers_zscore(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return outliers.remove_outliers_zscore(rows, ["c_acctbal"], 1.5)


# the pattern of each row follows k, so every pattern occurs
_MIXED = (
    "CASE WHEN k < 20 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN k < 40 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') "
    "WHEN k < 60 THEN strftime(ts, '%Y-%m-%d') WHEN k < 70 THEN strftime(ts, '%d/%m/%Y') "
    "WHEN k < 80 THEN strftime(ts, '%Y%m%d') WHEN k < 90 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE 'unknown' END"
)


@query(
    "normalize_ts_mixed",
    f"WITH {EVENTS}, m AS (SELECT event_id, {_MIXED} AS t FROM ev) SELECT event_id, coalesce("
    "try_strptime(rtrim(t, 'Z'), '%Y-%m-%dT%H:%M:%S'), try_strptime(t, '%Y-%m-%d %H:%M:%S'), try_strptime(t, '%Y-%m-%d'), "
    "try_strptime(t, '%Y%m%d'), try_strptime(t, '%d/%m/%Y')) AS \"timestamp\" FROM m WHERE t <> 'unknown'",
)
def normalize_ts_mixed(spark, sf):
    def shown(pattern):
        return F.date_format("ts", pattern)

    k = F.col("k")
    text = (
        F.when(k < 20, shown("yyyy-MM-dd'T'HH:mm:ss")).when(k < 40, shown("yyyy-MM-dd HH:mm:ss"))
        .when(k < 60, shown("yyyy-MM-dd")).when(k < 70, shown("dd/MM/yyyy"))
        .when(k < 80, shown("yyyyMMdd")).when(k < 90, shown("yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("unknown")
    )
    mixed = events(spark, sf).select("event_id", text.alias("timestamp"))
    return columns.normalize_timestamps(mixed)


@query(
    "filter_rows",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_discount <= 0.05 AND l_returnflag IN ('A', 'N')",
)
def filter_rows(spark, sf):
    kept = columns.filter_rows(
        table(spark, sf, "lineitem"), "l_quantity", "> 30 and l_discount <= 0.05 and l_returnflag in ['A', 'N']"
    )
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_not_equal", f"WITH {GAPPY} SELECT event_id, v FROM g WHERE v IS NULL OR v <> 0.5")
def filter_not_equal(spark, sf):
    return columns.filter_rows(gappy(spark, sf).select("event_id", "v"), "v", "!= 0.5")


@query("rename_drop", "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment FROM customer")
def rename_drop(spark, sf):
    renamed = columns.rename_columns(
        table(spark, sf, "customer"), {"c_custkey": "id", "c_acctbal": "balance", "absent": "x"}
    )
    return columns.drop_columns(renamed, ["c_name", "c_nationkey", "absent"])


@query(
    "add_column",
    "SELECT l_orderkey, l_linenumber, "
    f"{r('l_extendedprice * (1 - l_discount)', 2)} AS net, floor(l_quantity / 7) AS packs, l_quantity - 7 * floor(l_quantity / 7) AS loose, "
    "CASE WHEN l_discount <> 0 THEN floor(l_tax / l_discount * 1e4 + 0.50001) / 1e4 END AS ratio, 'x' AS tag FROM lineitem",
)
def add_column(spark, sf):
    rows = table(spark, sf, "lineitem")
    for name, text in {
        "net": "l_extendedprice * (1 - l_discount)", "packs": "l_quantity // 7",
        "loose": "l_quantity % 7", "ratio": "l_tax / l_discount",
    }.items():
        rows = columns.add_column(rows, name, expression=text)
    rows = columns.add_column(rows, "tag", value="x")
    return rows.select(
        "l_orderkey", "l_linenumber", rounded("net", 2).alias("net"),
        F.col("packs").cast("double").alias("packs"), "loose", rounded("ratio").alias("ratio"), "tag",
    )


_AS_TEXT = "CASE WHEN k < 5 THEN 'n/a' ELSE CAST({c} AS VARCHAR) END"


def _text(column: str):
    return F.when(F.col("k") < 5, F.lit("n/a")).otherwise(F.col(column).cast("string"))


@query("convert_float", f"WITH {EVENTS}, t AS (SELECT event_id, {_AS_TEXT.format(c='value')} AS x FROM ev) SELECT event_id, try_cast(x AS DOUBLE) AS x FROM t")
def convert_float(spark, sf):
    return columns.convert_type(events(spark, sf).select("event_id", _text("value").alias("x")), "x", "float")


@query("convert_int", f"WITH {EVENTS}, t AS (SELECT event_id, {_AS_TEXT.format(c='user_id')} AS x FROM ev) SELECT event_id, try_cast(x AS BIGINT) AS x FROM t")
def convert_int(spark, sf):
    return columns.convert_type(events(spark, sf).select("event_id", _text("user_id").alias("x")), "x", "int")


@query("convert_datetime", "SELECT o_orderkey, o_orderdate AS day FROM orders")
def convert_datetime(spark, sf):
    text = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("day"))
    return columns.convert_type(text, "day", "datetime")


@query("convert_string", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def convert_string(spark, sf):
    return columns.convert_type(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "string")


def _resample_sql(width: str, aggregate: str, source: str = "ev", column: str = "value") -> str:
    """Gap-free bins per series. All widths divide a day, so bins align with the epoch."""
    return (
        f"WITH {GAPPY}, b AS (SELECT event_type, time_bucket(INTERVAL '{width}', ts, TIMESTAMP '2000-01-01') AS ts_bin, {aggregate} AS a FROM {source} GROUP BY 1, 2), "
        f"s AS (SELECT event_type, unnest(generate_series(min(ts_bin), max(ts_bin), INTERVAL '{width}')) AS ts_bin FROM b GROUP BY 1) "
    )


@query(
    "resample_mean_1h",
    _resample_sql("1 hour", "avg(value)") + f"SELECT s.ts_bin AS ts, event_type, {r('a')} AS value FROM s LEFT JOIN b USING (event_type, ts_bin)",
)
def resample_mean_1h(spark, sf):
    """Flagship: hourly means per series on a gap-free grid."""
    out = resample(events(spark, sf).select("ts", "event_type", "value"), "ts", "1H", "mean", SERIES)
    return out.withColumn("value", rounded("value"))


@query(
    "resample_sum_1d",
    _resample_sql("1 day", "sum(v)", "g") + f"SELECT s.ts_bin AS ts, event_type, {r('coalesce(a, 0)')} AS v FROM s LEFT JOIN b USING (event_type, ts_bin)",
)
def resample_sum_1d(spark, sf):
    out = resample(gappy(spark, sf).select("ts", "event_type", "v"), "ts", "1D", "sum", SERIES)
    return out.withColumn("v", rounded("v"))


@query(
    "resample_count_15min",
    _resample_sql("15 minutes", "count(v)", "g") + "SELECT s.ts_bin AS ts, event_type, coalesce(a, 0) AS v FROM s LEFT JOIN b USING (event_type, ts_bin)",
)
def resample_count_15min(spark, sf):
    return resample(gappy(spark, sf).select("ts", "event_type", "v"), "ts", "15min", "count", SERIES)


@query(
    "resample_first_last_6h",
    _resample_sql(
        "6 hours",
        "{'f': arg_min(v, (ts, event_id)) FILTER (WHERE v IS NOT NULL), 'l': arg_max(k, (ts, event_id))}", "g",
    )
    + "SELECT s.ts_bin AS ts, event_type, a.f AS v, CAST(a.l AS DOUBLE) AS k FROM s LEFT JOIN b USING (event_type, ts_bin)",
)
def resample_first_last_6h(spark, sf):
    rows = gappy(spark, sf).select("ts", "event_type", "event_id", "v", "k")
    return resample(rows, "ts", "6H", {"v": "first", "k": "last"}, SERIES, order=ORDER)


_SEVEN = "INTERVAL '7 hours'"


@query(
    "resample_median_7h",
    f"WITH {GAPPY}, o AS (SELECT date_trunc('day', min(ts)) AS o FROM g), "
    f"b AS (SELECT time_bucket({_SEVEN}, ts, (SELECT o FROM o)) AS ts, median(v) AS v FROM g GROUP BY 1), "
    f"s AS (SELECT unnest(generate_series(min(ts), max(ts), {_SEVEN})) AS ts FROM b) "
    f"SELECT s.ts, {r('v')} AS v FROM s LEFT JOIN b USING (ts)",
)
def resample_median_7h(spark, sf):
    out = resample(gappy(spark, sf).select("ts", "v"), "ts", "7h", "median")
    return out.withColumn("v", rounded("v"))


@query(
    "resample_week",
    "WITH b AS (SELECT date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS w, sum(o_totalprice) AS a, max(o_totalprice) AS m FROM orders GROUP BY 1), "
    "s AS (SELECT unnest(generate_series(min(w), max(w), INTERVAL 7 DAY)) AS w FROM b) "
    f"SELECT CAST(s.w AS TIMESTAMP) AS o_orderdate, {r('coalesce(a, 0)', 2)} AS total, m AS top FROM s LEFT JOIN b USING (w)",
)
def resample_week(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderdate", F.col("o_totalprice").alias("total"), F.col("o_totalprice").alias("top"))
    out = resample(rows, "o_orderdate", "W", {"total": "sum", "top": "max"})
    return out.withColumn("total", rounded("total", 2))


@query(
    "resample_month",
    "SELECT o_orderstatus, CAST(last_day(o_orderdate) AS TIMESTAMP) AS o_orderdate, min(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2",
)
def resample_month(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderdate", "o_orderstatus", "o_totalprice")
    return resample(rows, "o_orderdate", "ME", "min", ["o_orderstatus"])


@query(
    "resample_quarter",
    "SELECT CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS TIMESTAMP) AS o_orderdate, "
    f"{r('avg(o_totalprice)', 2)} AS mean, {r('stddev_samp(o_totalprice)', 2)} AS std FROM orders GROUP BY 1",
)
def resample_quarter(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderdate", F.col("o_totalprice").alias("mean"), F.col("o_totalprice").alias("std"))
    out = resample(rows, "o_orderdate", "Q", {"mean": "mean", "std": "std"})
    return out.withColumns({c: rounded(c, 2) for c in ("mean", "std")})


@query(
    "ohlcv_daily",
    f"WITH {EVENTS} SELECT event_type, date_trunc('day', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, "
    f"min(value) AS low, arg_max(value, (ts, event_id)) AS close, {r('sum(k)', 1)} AS vol, "
    "arg_max(value, (ts, event_id)) >= arg_min(value, (ts, event_id)) AS up FROM ev GROUP BY event_type, date_trunc('day', ts)",
)
def ohlcv_daily(spark, sf):
    out = ohlcv_bars(events(spark, sf), "ts", "value", "1D", SERIES, "k", ORDER)
    return out.withColumn("vol", rounded(F.col("vol").cast("double"), 1))


def _interpolate_sql(by: str, at: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    back = f"OVER ({part}ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    fore = f"OVER ({part}ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return (
        f"WITH {GAPPY}, p AS (SELECT *, CAST({at.format(part=part)} AS DOUBLE) AS x FROM g), "
        f"n AS (SELECT *, last_value(v IGNORE NULLS) {back} AS v0, last_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) {back} AS x0, "
        f"first_value(v IGNORE NULLS) {fore} AS v1, first_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) {fore} AS x1 FROM p) "
        "SELECT event_id, floor((CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0 "
        "ELSE v0 + (v1 - v0) * (x - x0) / (x1 - x0) END) * 1e4 + 0.50001) / 1e4 AS v FROM n"
    )


_POSITION = "row_number() OVER ({part}ORDER BY ts, event_id)"


def _interpolated(spark, sf, by, method):
    rows = gappy(spark, sf).select("event_id", "ts", "event_type", "v")
    return missing.interpolate(rows, ["v"], ORDER, by, method).select("event_id", rounded("v").alias("v"))


@query("interpolate_linear", _interpolate_sql("event_type", _POSITION))
def interpolate_linear(spark, sf):
    return _interpolated(spark, sf, SERIES, "linear")


@query("interpolate_whole_table", _interpolate_sql("", _POSITION))
def interpolate_whole_table(spark, sf):
    return _interpolated(spark, sf, [], "linear")


@query("interpolate_time", _interpolate_sql("event_type", "epoch_us(ts)"))
def interpolate_time(spark, sf):
    return _interpolated(spark, sf, SERIES, "time")


def _nearest_sql() -> str:
    """The nearer known neighbour by position, the earlier one on ties; outer gaps stay."""
    part = "PARTITION BY event_type ORDER BY ts, event_id "
    back, fore = f"OVER ({part}ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"OVER ({part}ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    at = "CASE WHEN v IS NOT NULL THEN x END"
    return (
        f"WITH {GAPPY}, p AS (SELECT *, row_number() OVER ({part}) AS x FROM g), "
        f"n AS (SELECT *, last_value(v IGNORE NULLS) {back} AS v0, last_value({at} IGNORE NULLS) {back} AS x0, "
        f"first_value(v IGNORE NULLS) {fore} AS v1, first_value({at} IGNORE NULLS) {fore} AS x1 FROM p) "
        "SELECT event_id, CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL OR v1 IS NULL THEN NULL "
        "WHEN x - x0 <= x1 - x THEN v0 ELSE v1 END AS v FROM n"
    )


@query("interpolate_nearest", _nearest_sql())
def interpolate_nearest(spark, sf):
    rows = gappy(spark, sf).select("event_id", "ts", "event_type", "v")
    return missing.interpolate(rows, ["v"], ORDER, SERIES, "nearest").select("event_id", "v")


@query("interpolate_bfill", _fill_sql("first_value", f"PARTITION BY event_type {_BACKWARD}"))
def interpolate_bfill(spark, sf):
    rows = gappy(spark, sf).select("event_id", "ts", "event_type", "v")
    return missing.interpolate(rows, ["v"], ORDER, SERIES, "bfill").drop("ts")


@query("clip_values", f"WITH {GAPPY} SELECT event_id, CASE WHEN v IS NOT NULL THEN greatest(5.0, least(100.0, v)) END AS v FROM g")
def clip_values(spark, sf):
    return columns.clip_values(gappy(spark, sf).select("event_id", "v"), "v", 5.0, 100.0)


@query(
    "round_half_even",
    "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * 100.0, 0) / 100.0 AS l_extendedprice, "
    "round_even(l_discount * l_quantity * 100.0, 0) / 100.0 AS cut FROM lineitem",
)
def round_half_even(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_discount") * F.col("l_quantity")).alias("cut")
    )
    return columns.round_values(rows, ["l_extendedprice", "cut"], 2)


@query(
    "cleaning_steps",
    f"WITH {GAPPY}, a AS (SELECT event_id, ts, event_type, "
    f"last_value(v IGNORE NULLS) OVER (PARTITION BY event_type {_FORWARD}) AS v FROM g), "
    f"b AS (SELECT * FROM a WHERE v IS NOT NULL AND v > 1), {_iqr_cte('c', 'b', 'v')} "
    "SELECT event_id, round_even(least(v, 120.0) * 2 * 10.0, 0) / 10.0 AS double_v FROM c",
)
def cleaning_steps(spark, sf):
    """A declarative list of steps, one of which does not apply and is left out."""
    rows = gappy(spark, sf).select("event_id", "ts", "event_type", "v")
    cleaned = clean(
        rows,
        [
            {"operation": "fill_na", "params": {"method": "ffill"}},
            {"operation": "drop_na", "params": {"subset": ["v"]}},
            {"operation": "drop_na", "params": {"subset": ["absent"]}},
            {"operation": "filter_rows", "params": {"column": "v", "condition": "> 1"}},
            {"operation": "remove_outliers", "params": {"method": "iqr", "columns": ["v"]}},
            {"operation": "clip_values", "params": {"column": "v", "max": 120.0}},
            {"operation": "add_column", "params": {"column": "double_v", "expression": "v * 2"}},
            {"operation": "round_values", "params": {"columns": ["double_v"], "decimals": 1}},
            {"operation": "drop_columns", "params": {"columns": ["ts", "event_type", "v"]}},
        ],
        order_by=ORDER,
        partition_by=SERIES,
    )
    return cleaned.df


@query(
    "batch_transform",
    "SELECT l_orderkey, l_linenumber, l_quantity AS qty, 'batch' AS origin FROM lineitem WHERE l_quantity >= 10",
)
def batch_transform(spark, sf):
    path = work_path(spark, "transformed")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    jobs.transform(
        rows,
        [
            {"operation": "drop_na", "params": {}},
            {"operation": "filter", "params": {"column": "l_quantity", "condition": ">= 10"}},
            {"operation": "rename_columns", "params": {"mapping": {"l_quantity": "qty"}}},
            {"operation": "drop_columns", "params": {"columns": ["l_tax"]}},
            {"operation": "add_column", "params": {"column": "origin", "value": "batch"}},
        ],
        path,
    )
    return spark.read.parquet(path)
