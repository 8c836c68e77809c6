"""Records: validation, conversion, parsing, storage."""

from pyspark.sql import functions as F

from tidewell.functions import tokens
from tidewell.operators import query as q
from tidewell.operators import records as rec
from tidewell.operators import reshape, store
from tidewell.plans import jobs
from tidewell.session import work_path
from tidewell.sinks import protocols
from tidewell.sources import formats, payload
from workload.registry import BARS, EVENTS, bars, events, query, records, table

# Every kind of broken record occurs: the value of k picks the defect.
_DEFECTS = {
    0: ('"timestamp":"{t}","measurements":{{"value":{v}}}', "Missing required field: series_id"),
    1: ('"series_id":"{s}","measurements":{{"value":{v}}}', "Missing required field: timestamp"),
    2: ('"series_id":"{s}","timestamp":"{t}"', "Missing required field: measurements"),
    3: ('"series_id":"","timestamp":"{t}","measurements":{{"value":{v}}}', "series_id must be a non-empty string"),
    4: ('"series_id":7,"timestamp":"{t}","measurements":{{"value":{v}}}', "series_id must be a non-empty string"),
    5: ('"series_id":"{s}","timestamp":5,"measurements":{{"value":{v}}}', "timestamp must be a string"),
    6: ('"series_id":"{s}","timestamp":"{t}","measurements":[{v}]', "measurements must be a dictionary"),
    7: ('"series_id":"{s}","timestamp":"{t}","measurements":{{}}', "measurements must contain at least one key-value pair"),
    8: ('"series_id":"{s}","timestamp":"{t}","measurements":{{"value":null}}', "Measurement 'value' must be a number or string"),
    9: ('"series_id":"{s}","timestamp":"{t}","measurements":{{"value":{v},"x":[1]}}', "Measurement 'x' must be a number or string"),
    10: ('"series_id":"{s}","timestamp":"{t}","measurements":{{"value":"{v}"}}', None),
    11: ('"series_id":"{s}","timestamp":"not a time","measurements":{{"value":{v}}}', None),
}
_GOOD = '"series_id":"{s}","timestamp":"{t}","measurements":{{"value":{v},"k":{k}}},"metadata":{{"user":"{u}"}},"format":"json"'
_QUOTE = str.maketrans({"'": "''"})


def _filled(template):
    """A JSON template as a string expression over the columns of events."""
    holes = {
        "s": F.col("event_type"), "t": tokens.iso_text(F.col("ts")), "v": F.col("value").cast("string"),
        "k": F.col("k").cast("string"), "u": F.col("user_id").cast("string"),
    }
    text = template.format(**{h: f"\x01{h}\x01" for h in holes})
    parts = text.split("\x01")
    return F.concat(F.lit("{"), *[holes[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)], F.lit("}"))


def json_lines(spark, sf):
    """Events as JSON text, some of it broken."""
    body = F.when(F.lit(False), "")
    for k, (template, _) in _DEFECTS.items():
        body = body.when(F.col("k") == k, _filled(template))
    return events(spark, sf).select("event_id", body.otherwise(_filled(_GOOD)).alias("value"))


_ERROR = "CASE k " + " ".join(
    f"WHEN {k} THEN '{e.translate(_QUOTE)}'" for k, (_, e) in _DEFECTS.items() if e
) + " END"


def _processed(spark, sf):
    return rec.process(rec.json_records(json_lines(spark, sf))).drop("value")


@query("validate_ts_records", f"WITH {EVENTS} SELECT event_id, {_ERROR} AS error FROM ev")
def validate_ts_records(spark, sf):
    return _processed(spark, sf).select("event_id", "error")


@query(
    "process_batch",
    f"WITH {EVENTS} SELECT event_id, event_type AS series_id, CASE WHEN k <> 11 THEN ts END AS \"timestamp\", "
    "CASE WHEN k <> 10 THEN value END AS value, CAST(CASE WHEN k > 11 THEN k END AS DOUBLE) AS k, "
    "CASE WHEN k > 11 THEN CAST(user_id AS VARCHAR) END AS \"user\" FROM ev WHERE k >= 10",
)
def process_batch(spark, sf):
    accepted = rec.split(_processed(spark, sf)).accepted
    return accepted.select(
        "event_id", "series_id", "timestamp", q.metric("value").alias("value"), q.metric("k").alias("k"),
        F.col("metadata")["user"].alias("user"),
    )


@query(
    "process_rejects",
    f"WITH {EVENTS} SELECT {_ERROR} AS error, count(*) AS n FROM ev WHERE k < 10 GROUP BY 1",
)
def process_rejects(spark, sf):
    return rec.split(_processed(spark, sf)).rejected.groupBy("error").agg(F.count("*").alias("n"))


# price records: the remainder of the customer key picks the shape or defect
_PRICE_SHAPES = [
    ('"ticker":"{s}","timestamp":"{t}","open":{p},"high":{p},"low":{p},"close":{p},"vol":{c}', None),
    ('"series_id":"{s}","timestamp":"{t}","measurements":{{"open":{p},"c":{p},"volume":{c}}}', None),
    ('"ticker":"{s}","timestamp":"{t}","adj close":{p}', None),
    ('"timestamp":"{t}","close":{p}', "Missing required field: ticker or series_id"),
    ('"ticker":"{s}","close":{p}', "Missing required field: timestamp"),
    ('"ticker":"{s}","timestamp":"{t}","volume":{c}', "Missing required field: close (or any numeric measurement)"),
    ('"ticker":"{s}","timestamp":"{t}","close":"x"', "close must be a number"),
    ('"ticker":"{s}","timestamp":"{t}","close":{p},"low":-1', "low must be non-negative"),
    ('"ticker":"{s}","timestamp":"{t}","close":{p},"v":"many"', "vol must be a number"),
    ('"ticker":"{s}","timestamp":"{t}","price":{p},"open":9,"measurements":{{"open":1,"last":2}},"metadata":{{"a":1}}', None),
    ('"ticker":7,"timestamp":"{t}","close":{p}', "ticker/series_id must be a non-empty string"),
]


def price_lines(spark, sf):
    o = bars(spark, sf).withColumn("shape", F.col("vol") % len(_PRICE_SHAPES))
    holes = {
        "s": F.col("ticker"), "t": F.date_format("timestamp", "yyyy-MM-dd"),
        "p": F.col("open").cast("string"), "c": F.col("vol").cast("string"),
    }
    body = F.when(F.lit(False), "")
    for i, (template, _) in enumerate(_PRICE_SHAPES):
        parts = template.format(**{h: f"\x01{h}\x01" for h in holes}).split("\x01")
        text = F.concat(F.lit("{"), *[holes[p] if j % 2 else F.lit(p) for j, p in enumerate(parts)], F.lit("}"))
        body = body.when(F.col("shape") == i, text)
    return o.select("o_orderkey", "shape", body.alias("value"))


_SHAPE = f"vol % {len(_PRICE_SHAPES)}"
_PRICE_ERROR = f"CASE {_SHAPE} " + " ".join(
    f"WHEN {i} THEN '{e}'" for i, (_, e) in enumerate(_PRICE_SHAPES) if e
) + " END"


@query("validate_financial", f"WITH {BARS} SELECT o_orderkey, {_PRICE_ERROR} AS error FROM bars")
def validate_financial(spark, sf):
    parsed = rec.json_records(price_lines(spark, sf).drop("shape"))
    return rec.process(parsed, "financial").select("o_orderkey", "error")


@query(
    "financial_to_ts",
    f"WITH {BARS}, s AS (SELECT *, {_SHAPE} AS shape FROM bars) SELECT o_orderkey, ticker AS series_id, timestamp, "
    "CASE shape WHEN 0 THEN open WHEN 1 THEN open WHEN 9 THEN 9 END AS open, CASE WHEN shape = 0 THEN open END AS close, "
    "CASE WHEN shape = 1 THEN open END AS c, CAST(CASE WHEN shape IN (0) THEN vol END AS DOUBLE) AS vol, "
    "CASE shape WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 0 WHEN 9 THEN 2 END AS measurements, false AS has_metadata "
    f"FROM s WHERE {_PRICE_ERROR} IS NULL",
)
def financial_to_ts(spark, sf):
    done = rec.process(rec.json_records(price_lines(spark, sf).drop("shape")), "financial")
    accepted = rec.split(done).accepted
    return accepted.select(
        "o_orderkey", "series_id", "timestamp", *[q.metric(m).alias(m) for m in ("open", "close", "c", "vol")],
        F.size("measurements").alias("measurements"), F.col("metadata").isNotNull().alias("has_metadata"),
    )


@query(
    "numeric_tokens",
    f"WITH {EVENTS}, t AS (SELECT event_id, CASE WHEN k < 10 THEN '' WHEN k < 20 THEN '1e5' WHEN k < 30 THEN ' ' || k || ' ' "
    "WHEN k < 40 THEN 'nan' WHEN k < 50 THEN '1.5e3' ELSE CAST(value AS VARCHAR) END AS token, k, value FROM ev) "
    "SELECT event_id, CASE WHEN k < 20 THEN NULL WHEN k < 30 THEN CAST(k AS DOUBLE) WHEN k < 40 THEN NULL WHEN k < 50 THEN 1500.0 ELSE value END AS num, "
    "CASE WHEN k < 10 THEN NULL WHEN k < 20 THEN '1e5' WHEN k < 30 THEN CAST(k AS VARCHAR) WHEN k < 40 THEN 'nan' WHEN k < 50 THEN '1500.0' ELSE CAST(value AS VARCHAR) END AS raw FROM t",
)
def numeric_tokens(spark, sf):
    k = F.col("k")
    token = (
        F.when(k < 10, "").when(k < 20, "1e5").when(k < 30, F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))
        .when(k < 40, "nan").when(k < 50, "1.5e3").otherwise(F.col("value").cast("string"))
    )
    return events(spark, sf).select("event_id", tokens.token_value(token).alias("v")).select("event_id", "v.num", "v.raw")


@query(
    "loose_dates",
    "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_orderdate WHEN o_custkey % 3 = 1 THEN o_orderdate "
    "WHEN day(o_orderdate) <= 12 THEN make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0) "
    "ELSE o_orderdate END AS day FROM orders",
)
def loose_dates(spark, sf):
    """Day comes before month wherever both fit."""
    turn = F.col("o_custkey") % 3
    day = F.col("o_orderdate")
    text = F.when(turn == 0, F.date_format(day, "yyyy/MM/dd")).when(turn == 1, F.date_format(day, "d-M-yyyy")).otherwise(
        F.date_format(day, "MM/dd/yyyy")
    )
    return table(spark, sf, "orders").select("o_orderkey", tokens.parse_loose(text).alias("day"))


@query(
    "iso_or_epoch",
    f"WITH {EVENTS} SELECT event_id, CASE WHEN k < 50 THEN date_trunc('second', ts) ELSE date_trunc('millisecond', ts) END AS at FROM ev",
)
def iso_or_epoch(spark, sf):
    seconds = F.unix_seconds("ts").cast("string")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    millis = F.unix_millis("ts").cast("string")
    text = F.when(F.col("k") < 25, seconds).when(F.col("k") < 50, iso).otherwise(millis)
    return events(spark, sf).select("event_id", tokens.parse_iso_or_epoch(text, "ms").alias("at"))


@query(
    "request_dates",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dashed, CAST(epoch(o_orderdate) AS BIGINT)::VARCHAR AS unix, "
    "strftime(o_orderdate, '%Y%m%d') AS compact, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders",
)
def request_dates(spark, sf):
    day = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", tokens.render_date(day, "YYYY-MM-DD").alias("dashed"), tokens.render_date(day, "unix").alias("unix"),
        tokens.render_date(day, "YYYYMMDD").alias("compact"), tokens.render_date(day, "iso").alias("iso"),
    )


@query("real_timestamps", f"WITH {EVENTS} SELECT event_id, date_trunc('second', ts) AS \"timestamp\" FROM ev WHERE k >= 30")
def real_timestamps(spark, sf):
    k = F.col("k")
    text = F.when(k < 20, F.concat(F.lit("row_"), F.col("event_id").cast("string"))).when(k < 30, "soon").otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    return q.real_timestamps(events(spark, sf).select("event_id", text.alias("timestamp")))


@query("tenant_rows", "SELECT event_id, user_id, value FROM events WHERE user_id = 7")
def tenant_rows(spark, sf):
    return q.tenant_rows(table(spark, sf, "events"), 7).select("event_id", "user_id", "value")


def _versions(spark, sf):
    """The table twice: as first stored, and a correction for part of the keys."""
    e = events(spark, sf).select(
        F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("timestamp"), "event_id", "value", "k"
    )
    return e, e.where(F.col("k") >= 60).withColumn("value", F.col("value") + 1000).withColumn(
        "event_id", F.col("event_id") + 10_000_000
    )


@query(
    "upsert_latest_wins",
    f"WITH {EVENTS}, e AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS timestamp, event_id, value, k FROM ev), "
    "u AS (SELECT series_id, timestamp, event_id, value FROM e UNION ALL SELECT series_id, timestamp, event_id + 10000000, value + 1000 FROM e WHERE k >= 60), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY series_id, timestamp ORDER BY event_id DESC) AS rn FROM u) "
    "SELECT series_id, timestamp, event_id, value FROM n WHERE rn = 1",
)
def upsert_latest_wins(spark, sf):
    first, correction = _versions(spark, sf)
    path = work_path(spark, "store")
    store.upsert(spark, path, first, ["event_id"])
    store.upsert(spark, path, correction, ["event_id"])
    return store.load(spark, path).select("series_id", "timestamp", "event_id", "value")


@query(
    "upsert_same_version",
    f"WITH {EVENTS}, e AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS timestamp, max(value) AS value, max(k) AS k FROM ev GROUP BY 1, 2) "
    "SELECT series_id, timestamp, CASE WHEN k >= 60 THEN value + 1000 ELSE value END AS value, CASE WHEN k >= 60 THEN k END AS extra FROM e",
)
def upsert_same_version(spark, sf):
    """The last write wins without any version, and brings a column the store did not have."""
    e = events(spark, sf).groupBy(
        F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("timestamp")
    ).agg(F.max("value").alias("value"), F.max("k").alias("extra"))
    path = work_path(spark, "store")
    store.upsert(spark, path, e.drop("extra"))
    store.upsert(spark, path, e.where("extra >= 60").withColumn("value", F.col("value") + 1000))
    store.upsert(spark, path, e.where("extra < 60").drop("extra"))
    return store.load(spark, path).select("series_id", "timestamp", "value", "extra")


@query(
    "new_keys",
    f"WITH {EVENTS} SELECT DISTINCT event_type AS series_id, date_trunc('hour', ts) AS timestamp FROM ev WHERE k >= 20 "
    "EXCEPT SELECT event_type, date_trunc('hour', ts) FROM ev WHERE k < 20",
)
def new_keys(spark, sf):
    e = events(spark, sf).select(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("timestamp"), "k")
    return store.new_keys(e.where("k < 20"), e)


@query("store_scan", "SELECT event_type AS series_id, ts AS timestamp, value FROM events")
def store_scan(spark, sf):
    path = work_path(spark, "store")
    store.save(records(spark, sf), path)
    return store.load(spark, path).select("series_id", "timestamp", q.metric("value").alias("value"))


@query(
    "file_inventory",
)
def file_inventory(spark, sf):
    """Files of a written store by type; paths differ by run."""
    path = work_path(spark, "store")
    store.save(records(spark, sf), path)
    found = q.search_files(q.file_inventory(spark, path), "date=2024-01", "parquet")
    return found.groupBy("type").agg(F.count("*").alias("files"), F.bool_and(F.col("size_bytes") > 0).alias("filled"))


@query(
    "union_missing_columns",
    "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer "
    "UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier",
)
def union_missing_columns(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance", "c_mktsegment AS segment")
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS balance", "s_name AS name")
    return reshape.union_records([c, s])


@query(
    "batch_outcomes",
    f"WITH {EVENTS} SELECT k // 25 AS part, count(*) AS total, count(*) FILTER (WHERE k >= 10) AS success, "
    "count(*) FILTER (WHERE k < 10) AS errors FROM ev GROUP BY 1",
)
def batch_outcomes(spark, sf):
    """Several folders of files, one read, counts per source."""
    path = work_path(spark, "landing")
    lines = json_lines(spark, sf).join(events(spark, sf).select("event_id", "k"), "event_id")
    lines.select((F.col("k") / 25).cast("int").alias("part"), "value").write.partitionBy("part").text(path)
    counts = jobs.batch_outcomes(spark, [f"{path}/part={i}" for i in range(4)], "jsonl")
    part = F.regexp_extract("source_file", r"part=(\d+)", 1).cast("int")
    return counts.groupBy(part.alias("part")).agg(*[F.sum(c).alias(c) for c in ("total", "success", "errors")])


@query(
    "batch_outcomes_line_protocol",
    f"WITH {EVENTS} SELECT k // 25 AS part, count(*) AS total, count(*) FILTER (WHERE k >= 10) AS success, "
    "count(*) FILTER (WHERE k < 10) AS errors FROM ev GROUP BY 1",
)
def batch_outcomes_line_protocol(spark, sf):
    """Outcomes per folder of line protocol files, some of whose lines are none."""
    path = work_path(spark, "landing-lines")
    rows = records(spark, sf).withColumn("number", q.metric("k").cast("int"))
    for i in range(4):
        own = rows.where(F.expr(f"number div 25 = {i}"))
        bad = own.where("number < 10").select(F.concat(F.lit("no line "), "series_id").alias("value"))
        protocols.line_protocol(own.where("number >= 10")).union(bad).write.text(f"{path}/part={i}")
    counts = jobs.batch_outcomes(spark, [f"{path}/part={i}" for i in range(4)], "influxdb")
    part = F.regexp_extract("source_file", r"part=(\d+)", 1).cast("int")
    return counts.groupBy(part.alias("part")).agg(*[F.sum(c).alias(c) for c in ("total", "success", "errors")])


@query(
    "api_payload",
    f"WITH {EVENTS} SELECT event_type AS series_id, ts AS timestamp, value AS close, CAST(k AS DOUBLE) AS extra FROM ev",
)
def api_payload(spark, sf):
    """Landed responses, one per user, each holding a list of points under a path."""
    point = F.struct(
        F.col("event_type").alias("symbol"), tokens.iso_text(F.col("ts")).alias("at"),
        F.col("value").alias("closePrice"), F.struct(F.col("k").alias("extra")).alias("measurements"),
    )
    daily = events(spark, sf).groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.array_agg(point).alias("points"))
    text = daily.select(F.to_json(F.struct(F.struct("points").alias("result"))).alias("text"))
    responses = text.select(F.parse_json("text").alias("response"))
    found = payload.extract_records(responses, "result.points")
    named = payload.map_fields(found, {"symbol": "ticker", "at": "timestamp", "closePrice": "close"})
    done = rec.split(rec.process(named, "financial")).accepted
    return done.select("series_id", "timestamp", q.metric("close").alias("close"), q.metric("extra").alias("extra"))


@query(
    "detect_formats",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'influxdb' WHEN 2 THEN 'jsonl' ELSE 'parquet' END AS fmt FROM documents",
)
def detect_formats(spark, sf):
    """Format of a path by its extension, for a table of paths."""
    endings = F.array(*[F.lit(e) for e in (".csv", ".LP", ".ndjson.gz", ".pq")])
    path = F.concat(F.lit("in.dir/file"), F.col("doc_id").cast("string"), F.get(endings, (F.col("doc_id") % 4).cast("int")))
    return table(spark, sf, "documents").select("doc_id", formats.format_of(path).alias("fmt"))
