"""Profiles, queries and reshaping."""

from pyspark.sql import functions as F

from tidewell.operators import duplicates, profile, reshape, store
from tidewell.operators import query as q
from tidewell.plans import jobs, quantiles
from tidewell.session import work_path
from workload.registry import (
    BARS, EVENTS, GAPPY, bar_records, bars, events, gappy, query, r, records, rounded, table,
)


def _profile_sql(columns, source, kinds):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{k}' AS dtype, count(*) AS total_rows, count(*) - count({c}) AS missing_values, "
        f"{r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_percentage FROM {source}"
        for c, k in zip(columns, kinds)
    )


@query(
    "profile_columns",
    f"WITH {GAPPY} " + _profile_sql(["event_id", "event_type", "v", "ts"], "g", ["bigint", "string", "double", "timestamp"]),
)
def profile_columns(spark, sf):
    out = profile.profile_columns(gappy(spark, sf).select("event_id", "event_type", "v", "ts"))
    return out.withColumn("missing_percentage", rounded("missing_percentage"))


@query(
    "duplicate_rows",
    "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_quantity, l_returnflag)",
)
def duplicate_rows(spark, sf):
    return duplicates.duplicate_rows(table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag"))


def _describe_sql(source, columns, extra=""):
    return " UNION ALL ".join(
        f"SELECT {extra}'{c}' AS column_name, count({c}) AS count, {r(f'avg({c})', 3)} AS mean, {r(f'stddev_samp({c})', 3)} AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, {r(f'quantile_cont({c}, 0.25)')} AS p25, {r(f'quantile_cont({c}, 0.5)')} AS p50, "
        f"{r(f'quantile_cont({c}, 0.75)')} AS p75, CAST(max({c}) AS DOUBLE) AS max FROM {source}"
        for c in columns
    )


def _rounded_stats(df):
    exact = df.withColumns({c: rounded(c) for c in ("p25", "p50", "p75")})
    return exact.withColumns({c: rounded(c, 3) for c in ("mean", "std")})


@query("describe_numeric", f"WITH {GAPPY} " + _describe_sql("g", ["v", "k"]))
def describe_numeric(spark, sf):
    return _rounded_stats(profile.describe_numeric(gappy(spark, sf).select("v", "k")))


@query(
    "quantiles_by_ranks",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS p, {r(f'quantile_cont({c}, {p})')} AS q FROM lineitem"
        for c in ("l_extendedprice", "l_quantity", "l_tax") for p in (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    ),
)
def quantiles_by_ranks(spark, sf):
    """The way of large tables: brackets for all columns and ranks at once, then running counts."""
    names, probs = ["l_extendedprice", "l_quantity", "l_tax"], [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    rows = table(spark, sf, "lineitem").select(*names)
    found = quantiles.exact_quantiles(rows, names, probs, small_rows=2_000)
    flat = [F.struct(F.lit(c).alias("column_name"), F.lit(p).alias("p"), rounded(F.lit(v).cast("double")).alias("q"))
            for c in names for p, v in zip(probs, found[c], strict=True)]
    return spark.range(1).select(F.explode(F.array(*flat)).alias("r")).select("r.*")


@query(
    "datetime_stats",
    f"SELECT 'ts' AS column_name, min(ts) AS min, max(ts) AS max, {r('(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6')} AS range_seconds FROM events",
)
def datetime_stats(spark, sf):
    out = profile.datetime_stats(table(spark, sf, "events").select("ts"))
    return out.withColumn("range_seconds", rounded("range_seconds"))


def _report_sql(title, source, width, columns):
    described = _describe_sql(source, columns, f"'{title}' AS source, (SELECT count(*) FROM {source}) AS total_rows, CAST({width} AS BIGINT) AS total_columns, ")
    return described


@query(
    "source_report",
    _report_sql("customers", "customer", 2, ["c_acctbal"]) + " UNION ALL " + _report_sql("suppliers", "supplier", 2, ["s_acctbal"]),
)
def source_report(spark, sf):
    c = table(spark, sf, "customer").select("c_name", "c_acctbal")
    s = table(spark, sf, "supplier").select("s_name", "s_acctbal")
    return _rounded_stats(jobs.report({"customers": c, "suppliers": s}))


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(f'corr({a}, {b})', 6)} AS correlation FROM lineitem"
        for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))
    ),
)
def corr_matrix(spark, sf):
    out = profile.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumn("correlation", rounded("correlation", 6))


@query(
    "histogram_bins",
    "WITH s AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w FROM lineitem) "
    f"SELECT CAST(least(floor((l_extendedprice - lo) / w), 9) AS BIGINT) AS bin, count(*) AS n, {r('any_value(lo + least(floor((l_extendedprice - lo) / w), 9) * w)')} AS lower "
    "FROM lineitem, s GROUP BY 1",
)
def histogram_bins(spark, sf):
    return profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 10).withColumn("lower", rounded("lower"))


@query(
    "box_stats",
    "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events), "
    "f AS (SELECT *, a - 1.5 * (c - a) AS lo, c + 1.5 * (c - a) AS hi FROM q) "
    f"SELECT {r('any_value(a)')} AS q1, {r('any_value(b)')} AS median, {r('any_value(c)')} AS q3, {r('any_value(lo)')} AS lower_fence, "
    f"{r('any_value(hi)')} AS upper_fence, count(*) FILTER (WHERE value < lo OR value > hi) AS outliers, "
    "min(value) FILTER (WHERE value >= lo) AS whisker_low, max(value) FILTER (WHERE value <= hi) AS whisker_high FROM events, f",
)
def box_stats(spark, sf):
    out = profile.box_stats(table(spark, sf, "events"), "value")
    return out.withColumns({c: rounded(c) for c in ("q1", "median", "q3", "lower_fence", "upper_fence")})


@query(
    "hourly_activity",
    "SELECT date_trunc('hour', ts) AS hour, count(*) AS records, count(DISTINCT event_type) AS series FROM events GROUP BY 1",
)
def hourly_activity(spark, sf):
    return q.hourly_activity(records(spark, sf))


@query("available_series", "SELECT DISTINCT event_type AS series_id FROM events")
def available_series(spark, sf):
    return q.available_series(records(spark, sf))


@query(
    "available_metrics",
    "SELECT DISTINCT event_type AS series_id, unnest(['k', 'value']) AS metric FROM events "
    "UNION ALL SELECT DISTINCT o_orderstatus, unnest(['close', 'high', 'low', 'open', 'vol']) FROM orders",
)
def available_metrics(spark, sf):
    both = reshape.union_records([records(spark, sf).drop("event_id"), bar_records(spark, sf).drop("o_orderkey")])
    return q.available_metrics(both)


@query(
    "is_financial",
    "SELECT DISTINCT event_type AS series_id, false AS is_financial FROM events UNION ALL SELECT DISTINCT o_orderstatus, true FROM orders",
)
def is_financial(spark, sf):
    both = reshape.union_records([records(spark, sf).drop("event_id"), bar_records(spark, sf).drop("o_orderkey")])
    return q.is_financial(both)


@query(
    "default_metric",
    "SELECT DISTINCT event_type AS series_id, 'value' AS metric FROM events UNION ALL SELECT DISTINCT o_orderstatus, 'close' FROM orders",
)
def default_metric(spark, sf):
    both = reshape.union_records([records(spark, sf).drop("event_id"), bar_records(spark, sf).drop("o_orderkey")])
    return q.default_metric(both)


def _observations(spark, sf):
    return events(spark, sf).select(
        F.col("event_type").alias("series_id"), F.col("ts").alias("timestamp"), "event_id", "value"
    )


@query(
    "series_range",
    "SELECT event_type AS series_id, ts AS timestamp, event_id, value FROM events WHERE event_type = 'click' "
    "AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' ORDER BY ts, event_id LIMIT 500",
)
def series_range(spark, sf):
    return q.series_range(
        _observations(spark, sf), "click", "2024-01-05 00:00:00", "2024-01-20 12:00:00", 500, ["event_id"]
    )


@query(
    "latest_n",
    "SELECT event_type AS series_id, ts AS timestamp, event_id, value FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 10",
)
def latest_n(spark, sf):
    mine = q.tenant_rows(events(spark, sf), 7).select(
        F.col("event_type").alias("series_id"), F.col("ts").alias("timestamp"), "event_id", "value"
    )
    return q.latest(mine, 10, ["event_id"])


@query(
    "half_open_range",
    "SELECT event_type AS series_id, ts AS timestamp, event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'",
)
def half_open_range(spark, sf):
    return q.half_open_range(_observations(spark, sf), "2024-01-10", "2024-01-11")


@query("measurement_gt", "SELECT event_id, event_type AS series_id FROM events WHERE value > 150")
def measurement_gt(spark, sf):
    return q.measurement_above(records(spark, sf), "value", 150).select("event_id", "series_id")


@query(
    "promoted_metric_gt",
    f"WITH {EVENTS} SELECT event_id, event_type AS series_id, value FROM ev WHERE value > 150",
)
def promoted_metric_gt(spark, sf):
    """A store that keeps ``value`` as a column: the filter is pushed down to its files."""
    path = work_path(spark, "promoted")
    store.save(records(spark, sf), path, ["value"])
    kept = q.measurement_above(store.load(spark, path), "value", 150)
    return kept.select("event_id", "series_id", q.from_map("value", kept).alias("value"))


@query("metric_projection", f"WITH {EVENTS} SELECT event_type AS series_id, ts AS timestamp, CAST(k AS DOUBLE) AS value FROM ev")
def metric_projection(spark, sf):
    return q.metric_values(records(spark, sf), "k")


@query(
    "ohlcv_extract",
    f"WITH {BARS} SELECT ticker AS series_id, timestamp, open, high, low, close, CAST(vol AS DOUBLE) AS volume, close >= open AS up FROM bars",
)
def ohlcv_extract(spark, sf):
    return q.ohlcv(bar_records(spark, sf))


@query(
    "ohlcv_columns",
    f"WITH {BARS} SELECT ticker AS series_id, timestamp, open, high, low, close, CAST(vol AS DOUBLE) AS volume, close >= open AS up FROM bars",
)
def ohlcv_columns(spark, sf):
    return q.ohlcv(bars(spark, sf).withColumnRenamed("ticker", "series_id"))


@query(
    "preview",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus "
    "FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice LIMIT 200",
)
def preview(spark, sf):
    ordered = table(spark, sf, "lineitem").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    return q.preview(ordered)


@query(
    "flatten_measurements",
    f"WITH {EVENTS} SELECT event_id, event_type AS series_id, ts AS timestamp, CAST(k AS DOUBLE) AS measurement_k, value AS measurement_value FROM ev",
)
def flatten_measurements(spark, sf):
    wide = reshape.flatten(records(spark, sf))
    return reshape.sorted_columns(wide.drop("timestamp_raw", "metadata", "format"))


@query(
    "expand_measurements",
    f"WITH {EVENTS} SELECT event_id, event_type AS series_id, CAST(k AS DOUBLE) AS k, CAST(value AS VARCHAR) AS value FROM ev",
)
def expand_measurements(spark, sf):
    """A measurement overwrites the field of the same name."""
    clash = records(spark, sf).withColumn("value", F.lit("own"))
    return reshape.expand(clash).select("event_id", "series_id", "k", "value")


@query(
    "unpivot_long",
    f"WITH {EVENTS} SELECT event_type AS series_id, ts AS timestamp, 'value' AS measurement, value FROM ev "
    "UNION ALL SELECT event_type, ts, 'k', CAST(k AS DOUBLE) FROM ev",
)
def unpivot_long(spark, sf):
    return reshape.unpivot_long(records(spark, sf)).drop("metadata")


@query(
    "aligned_arrays",
    f"WITH {EVENTS} SELECT event_type AS series_id, date_trunc('day', ts) AS block, count(*) AS points, min(ts) AS first, "
    f"arg_min(value, ts) AS first_value, CAST(arg_max(k, ts) AS DOUBLE) AS last_k FROM ev GROUP BY event_type, date_trunc('day', ts)",
)
def aligned_arrays(spark, sf):
    arrays = reshape.aligned_arrays(records(spark, sf), ["k", "value"])
    return arrays.select(
        "series_id", "block", F.size("timestamps").cast("long").alias("points"), F.get("timestamps", F.lit(0)).alias("first"),
        F.get("value", F.lit(0)).alias("first_value"), F.element_at("k", -1).alias("last_k"),
    )


@query(
    "plot_table",
    f"WITH {EVENTS} SELECT event_type AS series_id, ts AS timestamp, CAST(k AS DOUBLE) AS measurement_k, value AS measurement_value FROM ev",
)
def plot_table(spark, sf):
    return reshape.plot_table(records(spark, sf).select("series_id", "timestamp", "measurements"), ["k", "value"])


@query(
    "series_metadata",
    "WITH f AS (SELECT event_type, arg_min(user_id, ts) AS u FROM events GROUP BY 1) "
    "SELECT event_id, event_type AS series_id, CAST(u AS VARCHAR) AS \"user\" FROM events JOIN f USING (event_type)",
)
def series_metadata(spark, sf):
    rows = records(spark, sf)
    joined = store.with_series_metadata(rows.select("event_id", "series_id", "metadata"), rows)
    return joined.select("event_id", "series_id", F.col("metadata")["user"].alias("user"))
