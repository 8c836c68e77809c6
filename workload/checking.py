"""Jobs over whole tables that have an effect beside their rows: tables, exports, object listings, user steps, models."""

from uuid import uuid4

from pyspark.sql import functions as F

from tidewell.forecast import models
from tidewell.functions import tokens
from tidewell.operators import query as q
from tidewell.operators import records as rec
from tidewell.operators import steps, store
from tidewell.plans import jobs
from tidewell.session import work_path, written
from tidewell.sinks import files
from tidewell.sources import formats, payload
from workload.registry import EVENTS, GAPPY, events, gappy, query, r, records, rounded, table


@query(
    "csv_table",
    "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus, o_totalprice, 2 * (SELECT count(*) FROM orders) AS loaded "
    "FROM orders UNION ALL SELECT CAST(o_orderkey AS BIGINT), o_orderstatus, o_totalprice, 2 * (SELECT count(*) FROM orders) FROM orders",
)
def csv_table(spark, sf):
    """CSV files into a table, and once more appended to it."""
    source, name = work_path(spark, "orders.csv"), f"tidewell_{uuid4().hex}"
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.option("header", True).csv(source)
    jobs.csv_to_table(spark, source, name)
    loaded = jobs.csv_to_table(spark, source, name, if_exists="append")
    rows = spark.table(name).select(F.col("o_orderkey").cast("long"), "o_orderstatus", "o_totalprice", F.lit(loaded).alias("loaded"))
    out = written(rows, "loaded")
    spark.sql(f"DROP TABLE {name}")
    return out


@query(
    "batch_export",
    "SELECT fmt, CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus, o_totalprice "
    "FROM orders, (VALUES ('csv'), ('json'), ('parquet')) f(fmt)",
)
def batch_export(spark, sf):
    """A plain table exported in each format, and read again."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = work_path(spark, f"orders.{fmt}")
        jobs.export(rows, path, fmt)
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        back = reader.schema("o_orderkey long, o_orderstatus string, o_totalprice double").format(fmt).load(path)
        back = back.select(F.lit(fmt).alias("fmt"), "*")
        out = back if out is None else out.union(back)
    return out


@query(
    "convertible_files",
    "SELECT doc_id, doc_id % 5 IN (0, 1, 2) AND doc_id % 3 <> 2 AS convertible FROM documents",
)
def convertible_files(spark, sf):
    """Which files of a listing can be converted to a wanted format."""
    endings = F.array(*[F.lit(e) for e in (".CSV.bz2", ".ndjson", ".lp", ".xlsx", ".unknown")])
    path = F.concat(F.lit("in/file"), F.col("doc_id").cast("string"), F.get(endings, (F.col("doc_id") % 5).cast("int")))
    target = F.get(F.array(F.lit("parquet"), F.lit("InfluxDB"), F.lit("zarr")), (F.col("doc_id") % 3).cast("int"))
    return table(spark, sf, "documents").select("doc_id", jobs.convertible(path, target).alias("convertible"))


@query(
    "detected_files",
    f"WITH {EVENTS} SELECT event_type AS series_id, ts AS timestamp, value, ['csv', 'json', 'parquet'][k % 3 + 1] AS ending FROM ev",
)
def detected_files(spark, sf):
    """Paths of several formats in one read, each by its own extension."""
    rows, root = records(spark, sf), work_path(spark, "mixed")
    paths = []
    for i, ending in enumerate(("csv", "json", "parquet")):
        paths.append(f"{root}/part.{ending}")
        own = rows.where(q.metric("k").cast("int") % 3 == i).select("series_id", F.col("timestamp_raw").alias("timestamp"), "measurements")
        files.write_records(own, paths[-1], formats.detect_format(paths[-1]))
    read = rec.split(rec.check_canonical(formats.read_records(spark, paths))).accepted
    ending = F.regexp_extract("source_file", r"/part\.(\w+)/", 1)
    # flattened files carry names with a prefix
    value = F.coalesce(q.metric("value"), q.metric("measurement_value"))
    return read.select("series_id", "timestamp", value.alias("value"), ending.alias("ending"))


@query(
    "object_search",
    "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, 'PARQUET' AS type, true AS filled FROM events WHERE strftime(ts, '%Y-%m-%d') LIKE '%-1%'",
)
def object_search(spark, sf):
    """Objects of a store by a part of their name and their extension."""
    path = work_path(spark, "store")
    store.save(records(spark, sf), path)
    found = q.search_files(q.file_inventory(spark, path), "-1", "parquet", series="DATE=")
    day = F.regexp_extract("key", r"date=(\d{4}-\d\d-\d\d)/", 1)
    # the run's folder may hold "-1" as well; only names of days count
    found = found.withColumn("day", day).where(F.contains("day", F.lit("-1")))
    return found.groupBy("day", "type").agg(F.bool_and(F.col("size_bytes") > 0).alias("filled"))


@query(
    "byte_sizes",
    "SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576) "
    "WHEN n >= 1024 THEN printf('%.2f KB', n / 1024) ELSE n || ' B' END AS size "
    "FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey * 128 WHEN 1 THEN o_custkey "
    "ELSE o_orderkey * o_custkey * 1000 END AS n FROM orders)",
)
def byte_sizes(spark, sf):
    n = F.expr(
        "CASE o_orderkey % 3 WHEN 0 THEN o_orderkey * 128L WHEN 1 THEN CAST(o_custkey AS LONG) ELSE 1000L * o_orderkey * o_custkey END"
    )
    return table(spark, sf, "orders").select("o_orderkey", tokens.byte_size(n).alias("size"))


@steps.step("mark_above")
def _mark_above(df, params, at):
    """A step of a user: rows whose value lies above a bound."""
    return df.withColumn(params["to"], F.col(params["column"]) > params["bound"])


@query("cleaning_user_step", f"WITH {GAPPY} SELECT event_id, v, v > 50 AS high, true AS marked, false AS unknown FROM g WHERE v IS NOT NULL")
def cleaning_user_step(spark, sf):
    """A step registered by the user between those of the library; an unknown one changes nothing and is reported."""
    done = steps.clean(
        gappy(spark, sf).select("event_id", "v"),
        [
            {"operation": "drop_na", "params": {"columns": ["v"]}},
            {"operation": "mark_above", "params": {"column": "v", "bound": 50, "to": "high"}},
            {"operation": "no_such_step"},
        ],
        order_by=["event_id"],
    )
    applied = {s.operation: s.applied for s in done.report}
    return done.df.withColumns({"marked": F.lit(applied["mark_above"]), "unknown": F.lit(applied["no_such_step"])})


_FIT = "regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a"


@query(
    "linear_weights",
    f"WITH f AS (SELECT {_FIT} FROM lineitem) SELECT {r('b', 2)} AS slope, {r('a', 2)} AS intercept, "
    f"{r('(SELECT sqrt(avg((l_extendedprice - a - b * l_quantity) ** 2)) FROM lineitem)', 2)} AS rmse FROM f",
)
def linear_weights(spark, sf):
    """A line through all rows, by the normal equations."""
    fitted = models.linear_regression(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", train_share=1)
    numbers = {"slope": fitted.importance["l_quantity"], "intercept": fitted.model.intercept, "rmse": fitted.rmse}
    return spark.range(1).select(*[rounded(F.lit(float(x)), 2).alias(n) for n, x in numbers.items()])


@query("kmeans_nearest", "SELECT c_custkey, true AS nearest FROM customer")
def kmeans_nearest(spark, sf):
    """Every row belongs to the cluster whose centre is nearest."""
    labelled, model = models.clusters(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], 4)
    far = [F.abs(F.col("c_acctbal") - float(c[0])) for c in model.clusterCenters()]
    own = F.get(F.array(*far), F.col("cluster").cast("int"))
    return labelled.select("c_custkey", (own <= F.least(*far) + 1e-9).alias("nearest"))


@query(
    "api_response_rejects",
    f"WITH {EVENTS} SELECT k, CASE WHEN k < 10 THEN 0 ELSE count(*) END AS points, k < 10 AS rejected FROM ev GROUP BY k",
)
def api_response_rejects(spark, sf):
    """Landed responses, one file for each ``k``; files cut short are rejects, and every file is one or the other."""
    path = work_path(spark, "responses")
    text = events(spark, sf).groupBy("k").agg(F.to_json(F.struct(F.array_agg("value").alias("data"))).alias("text"))
    cut = F.when(F.col("k") < 10, F.expr("left(text, length(text) - 2)")).otherwise(F.col("text"))
    text.select("k", cut.alias("value")).write.partitionBy("k").text(path)
    responses = payload.read_responses(spark, path)
    k = F.regexp_extract("source_file", r"k=(\d+)/", 1).cast("int").alias("k")
    good = payload.extract_records(responses).groupBy(k).agg(F.count("*").alias("points"), F.lit(False).alias("rejected"))
    bad = payload.rejected_responses(responses).select(k, F.lit(0).cast("long").alias("points"), F.lit(True).alias("rejected"))
    return good.unionByName(bad)
