"""Protocol lines, JSON rows, and write-then-read round trips of every file format."""

from pyspark.sql import functions as F

from tidewell.operators import query as q
from tidewell.operators import records as rec
from tidewell.operators import reshape
from tidewell.plans import jobs
from tidewell.session import work_path
from tidewell.sinks import files, protocols
from tidewell.sources import formats
from tidewell.sources import protocols as protocol_sources
from tidewell.sources import text as text_files
from workload.registry import BARS, EVENTS, bar_records, bars, events, query, r, records, rounded, table

_NS = "CAST(epoch_us(ts) * CAST(1000 AS BIGINT) AS VARCHAR)"
_K = "CAST(k AS VARCHAR)"
_V = "CAST(value AS VARCHAR)"
_USER = "CAST(user_id AS VARCHAR)"


@query("line_protocol", f"WITH {EVENTS} SELECT event_type || ' value=' || {_V} || ',k=' || {_K} || ' ' || {_NS} AS value FROM ev")
def line_protocol(spark, sf):
    return protocols.line_protocol(records(spark, sf))


@query(
    "line_protocol_text",
    f"WITH {EVENTS} SELECT 'my\\ ' || event_type || '\\,x kind=\"say \\\"' || event_type || '\\\"\",value=' || {_V} || ' ' || {_NS} AS value FROM ev",
)
def line_protocol_text(spark, sf):
    """Names with blanks and commas, text with quotes."""
    e = events(spark, sf)
    kind = F.concat(F.lit('say "'), F.col("event_type"), F.lit('"'))
    named = records(spark, sf).join(e.select("event_id", kind.alias("kind")), "event_id")
    rows = named.select(
        F.concat(F.lit("my "), F.col("series_id"), F.lit(",x")).alias("series_id"), "timestamp",
        F.map_from_arrays(
            F.array(F.lit("kind"), F.lit("value")),
            F.array(
                F.struct(F.lit(None).cast("double").alias("num"), F.col("kind").alias("raw")),
                F.col("measurements")["value"],
            ),
        ).alias("measurements"),
    )
    return protocols.line_protocol(rows)


@query(
    "questdb_ilp",
    f"WITH {EVENTS} SELECT 'readings,series_id=' || event_type || ',user=' || {_USER} || ' value=' || {_V} || ',k=' || {_K} || ' ' || {_NS} AS value FROM ev",
)
def questdb_ilp(spark, sf):
    return protocols.questdb_lines(records(spark, sf), "readings")


_SEC = "CAST(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS VARCHAR)"


@query(
    "opentsdb_lines",
    f"WITH {EVENTS} SELECT 'put ' || event_type || '.value ' || {_SEC} || ' ' || {_V} || ' user=' || {_USER} AS value FROM ev "
    f"UNION ALL SELECT 'put ' || event_type || '.k ' || {_SEC} || ' ' || {_K} || ' user=' || {_USER} FROM ev",
)
def opentsdb_lines(spark, sf):
    return protocols.opentsdb_lines(records(spark, sf))


@query(
    "opentsdb_one_metric",
    f"WITH {EVENTS} SELECT 'put all.value ' || {_SEC} || ' ' || {_V} || ' series_id=' || event_type || ' user=' || {_USER} AS value FROM ev "
    f"UNION ALL SELECT 'put all.k ' || {_SEC} || ' ' || {_K} || ' series_id=' || event_type || ' user=' || {_USER} FROM ev",
)
def opentsdb_one_metric(spark, sf):
    return protocols.opentsdb_lines(records(spark, sf), "all")


_MS = "CAST(floor(epoch_us(ts) / 1000) AS BIGINT)"
_LONG = (
    "long AS (SELECT event_id, user_id, event_type, ts, 'value' AS m, value AS x FROM ev "
    "UNION ALL SELECT event_id, user_id, event_type, ts, 'k', CAST(k AS DOUBLE) FROM ev)"
)


@query(
    "prometheus_samples",
    f"WITH {EVENTS}, {_LONG} SELECT event_type || '_' || m AS name, event_type AS series_id, {_USER} AS \"user\", {_MS} AS \"timestamp\", x AS value, 3::BIGINT AS labels FROM long",
)
def prometheus_samples(spark, sf):
    rows = protocols.prometheus_rows(records(spark, sf))
    labels = F.map_from_entries("labels")
    sample = F.get("samples", F.lit(0))
    return rows.select(
        F.element_at(labels, "__name__").alias("name"), F.element_at(labels, "series_id").alias("series_id"),
        F.element_at(labels, "user").alias("user"), sample["timestamp"].alias("timestamp"), sample["value"].alias("value"),
        F.size("labels").cast("long").alias("labels"),
    )


@query(
    "victoria_points",
    f"WITH {EVENTS}, {_LONG}, first AS (SELECT event_type, arg_min({_USER}, (ts, {_USER})) AS \"user\" FROM ev GROUP BY 1) "
    f"SELECT event_type || '_' || m AS name, \"user\", {_MS} AS \"timestamp\", x AS value FROM long JOIN first USING (event_type)",
)
def victoria_points(spark, sf):
    """Every point carries the labels of the first record of its series."""
    rows = protocols.victoria_rows(records(spark, sf), block=None)
    return rows.select(
        F.element_at("metric", "__name__").alias("name"), F.element_at("metric", "user").alias("user"),
        F.get("timestamps", F.lit(0)).alias("timestamp"), F.get("values", F.lit(0)).alias("value"),
    )


@query(
    "victoria_blocks",
    f"WITH {EVENTS}, {_LONG} SELECT event_type || '_' || m AS name, count(*) AS points, min({_MS}) AS first_ms, "
    f"{r('sum(x)', 2)} AS total FROM long GROUP BY event_type, m, date_trunc('hour', ts)",
)
def victoria_blocks(spark, sf):
    """One row per series, measurement and hour."""
    rows = protocols.victoria_rows(records(spark, sf))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        F.element_at("metric", "__name__").alias("name"), F.size("values").cast("long").alias("points"),
        F.get("timestamps", F.lit(0)).alias("first_ms"), rounded(total, 2).alias("total"),
    )


@query("tsfile_rows", f"WITH {EVENTS}, {_LONG} SELECT event_type AS device, {_MS} AS \"timestamp\", m AS measurement, x AS value FROM long")
def tsfile_rows(spark, sf):
    return protocols.tsfile_rows(records(spark, sf))


@query(
    "proto_json",
    f"WITH {EVENTS} SELECT event_type AS series_id, epoch_us(ts) * CAST(1000 AS BIGINT) AS ns, value, CAST(k AS DOUBLE) AS k, {_USER} AS \"user\" FROM ev",
)
def proto_json(spark, sf):
    rows = protocols.protobuf_rows(records(spark, sf))
    return rows.select(
        "series_id", F.col("timestamp").cast("bigint").alias("ns"),
        *[F.element_at("fields", m).cast("double").alias(m) for m in ("value", "k")],
        F.col("metadata")["user"].alias("user"),
    )


@query(
    "timescale_rows",
    f"WITH {EVENTS}, {_LONG} SELECT ts AS time, event_type AS series_id, m AS measurement_name, x AS value, '{{\"user\":\"' || {_USER} || '\"}}' AS metadata FROM long",
)
def timescale_rows(spark, sf):
    return protocols.timescale_rows(records(spark, sf))


@query(
    "timescale_lines",
    f"WITH {EVENTS}, {_LONG} SELECT 'INSERT INTO readings (time, series_id, measurement_name, value, metadata) VALUES (''' || "
    "strftime(ts, '%Y-%m-%d %H:%M:%S') || ''', ''' || event_type || ''', ''' || m || ''', ' || CAST(x AS VARCHAR) || "
    f"', ''{{\"user\":\"' || {_USER} || '\"}}'');' AS value FROM long",
)
def timescale_lines(spark, sf):
    return protocols.timescale_lines(records(spark, sf), "readings")


@query(
    "tdengine_lines",
    f"WITH {EVENTS}, {_LONG} SELECT 'INSERT INTO readings USING readings_tags TAGS (''' || m || ''') VALUES (''' || "
    "strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ''', ''' || event_type || ''', ' || CAST(x AS VARCHAR) || ');' AS value FROM long",
)
def tdengine_lines(spark, sf):
    return protocols.tdengine_lines(records(spark, sf), "readings")


@query(
    "stooq_rows",
    f"WITH {BARS} SELECT ticker AS \"TICKER\", 'D' AS \"PER\", strftime(timestamp, '%Y%m%d') AS \"DATE\", '000000' AS \"TIME\", "
    "printf('%.2f', open) AS \"OPEN\", printf('%.2f', high) AS \"HIGH\", printf('%.2f', low) AS \"LOW\", printf('%.2f', close) AS \"CLOSE\", "
    "CAST(vol AS VARCHAR) AS \"VOL\", '0' AS \"OPENINT\" FROM bars",
)
def stooq_rows(spark, sf):
    return protocols.stooq_rows(bar_records(spark, sf))


_BACK = f"WITH {EVENTS} SELECT event_type AS series_id, ts AS timestamp, value, CAST(k AS DOUBLE) AS k FROM ev"


def _back(df):
    """What a round trip must return: both measurements under their series and time."""
    good = rec.split(rec.check_canonical(df)).accepted
    return good.select("series_id", "timestamp", q.metric("value").alias("value"), q.metric("k").alias("k"))


def _plain(spark, sf):
    """Records without columns of their own beyond the canonical ones."""
    return records(spark, sf).select("series_id", F.col("timestamp_raw").alias("timestamp"), "measurements")


def _round_trip(spark, sf, fmt, reader=None, **options):
    path = work_path(spark, f"events-{fmt}")
    files.write_records(_plain(spark, sf), path, fmt, **options)
    return formats.read_records(spark, path, reader or fmt)


@query("roundtrip_json", _BACK)
def roundtrip_json(spark, sf):
    return _back(_round_trip(spark, sf, "json"))


@query("json_array_records", _BACK)
def json_array_records(spark, sf):
    """Files that each hold one array, on one line."""
    path = work_path(spark, "events-arrays")
    numbers = F.transform_values("measurements", lambda _, v: protocols.token(v))
    rows = records(spark, sf).withColumn("measurements", numbers)
    line = F.to_json(F.struct("series_id", F.col("timestamp_raw").alias("timestamp"), "measurements"))
    arrays = rows.groupBy(F.expr("event_id div 10000")).agg(F.array_join(F.collect_list(line), ",").alias("lines"))
    whole = arrays.select(F.concat(F.lit("["), "lines", F.lit("]")))
    whole.write.option("maxRecordsPerFile", 1).text(path)
    return _back(formats.read_records(spark, path, "json"))


@query("roundtrip_jsonl_gzip", _BACK)
def roundtrip_jsonl_gzip(spark, sf):
    return _back(_round_trip(spark, sf, "gzip", "jsonl", inner="jsonl"))


@query("roundtrip_csv_bzip2", _BACK)
def roundtrip_csv_bzip2(spark, sf):
    return _prefixed(_round_trip(spark, sf, "bzip2", "csv", inner="csv"))


def _prefixed(df):
    """Flattened files carry ``measurement_`` names."""
    good = rec.split(rec.check_canonical(df)).accepted
    return good.select(
        "series_id", "timestamp", q.metric("measurement_value").alias("value"), q.metric("measurement_k").alias("k")
    )


@query("roundtrip_csv", _BACK)
def roundtrip_csv(spark, sf):
    return _prefixed(_round_trip(spark, sf, "csv"))


@query("roundtrip_txt", f"WITH {EVENTS} SELECT event_type AS series_id, date_trunc('second', ts) AS timestamp, value, CAST(k AS DOUBLE) AS k FROM ev")
def roundtrip_txt(spark, sf):
    """Tab-separated, separator and column roles found by looking."""
    path = work_path(spark, "events-txt")
    whole = _plain(spark, sf).withColumn("timestamp", F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    files.write_records(whole, path, "txt")
    return _prefixed(formats.read_records(spark, path, "txt"))


@query("roundtrip_csv_headerless", f"WITH {EVENTS} SELECT event_type AS series_id, ts AS timestamp, value, CAST(k AS DOUBLE) AS k FROM ev")
def roundtrip_csv_headerless(spark, sf):
    path = work_path(spark, "events-headerless")
    rows = records(spark, sf).select(
        "series_id", "timestamp_raw", q.metric("value"), q.metric("k").cast("int")
    )
    rows.write.csv(path)
    got = rec.split(rec.check_canonical(text_files.read_csv(spark, path, header=False))).accepted
    return got.select(
        "series_id", "timestamp", q.metric("measurement_0").alias("value"), q.metric("measurement_1").alias("k")
    )


@query("csv_mixed_headers", _BACK)
def csv_mixed_headers(spark, sf):
    """Files of one folder whose headers name the columns in different orders."""
    path = work_path(spark, "events-headers")
    rows = records(spark, sf).select(
        "event_id", "series_id", F.col("timestamp_raw").alias("timestamp"), q.metric("value").alias("value"), q.metric("k").alias("k")
    )
    orders = [["series_id", "timestamp", "value", "k"], ["k", "value", "timestamp", "series_id"], ["timestamp", "k", "series_id", "value"]]
    for i, names in enumerate(orders):
        part = rows.where(F.col("event_id") % len(orders) == i).select(*names)
        part.write.mode("append").option("header", True).csv(path)
    return _back(formats.read_records(spark, path, "csv"))


@query("txt_mixed_layouts", _BACK.replace("ts AS timestamp", "date_trunc('second', ts) AS timestamp"))
def txt_mixed_layouts(spark, sf):
    """Delimited files of one folder that differ in separator, order and names of their columns."""
    path = work_path(spark, "events-layouts")
    rows = records(spark, sf).select(
        "event_id", F.col("series_id").alias("SYMBOL"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("DATE"),
        q.metric("value").alias("value"), q.metric("k").alias("k"),
    )
    kinds = [(";", ["SYMBOL", "DATE", "value", "k"]), ("\t", ["k", "DATE", "SYMBOL", "value"]), ("|", ["value", "k", "DATE", "SYMBOL"])]
    for i, (sep, names) in enumerate(kinds):
        part = rows.where(F.col("event_id") % len(kinds) == i).select(*names)
        part.write.mode("append").option("header", True).option("sep", sep).csv(path)
    good = rec.split(rec.check_canonical(formats.read_records(spark, path, "txt"))).accepted
    return good.select("series_id", "timestamp", q.metric("value").alias("value"), q.metric("k").alias("k"))


@query(
    "jsonl_trailing_text",
    f"WITH {EVENTS} SELECT event_type AS series_id, ts AS timestamp, value, CAST(k AS DOUBLE) AS k FROM ev WHERE k % 7 NOT IN (1, 2, 3, 4)",
)
def jsonl_trailing_text(spark, sf):
    """Lines with more than one value are rejects: junk, a second object, a comma, a stray bracket."""
    path = work_path(spark, "events-trailing")
    line = F.to_json(F.struct("series_id", F.col("timestamp_raw").alias("timestamp"), F.transform_values("measurements", lambda _, v: protocols.token(v)).alias("measurements")))
    kind = q.metric("k").cast("int") % 7
    tail = F.when(kind == 1, " junk").when(kind == 2, line).when(kind == 3, F.concat(F.lit(","), line)).when(kind == 4, "]").otherwise("  ")
    records(spark, sf).select(F.concat(line, tail).alias("value")).write.text(path)
    return _back(formats.read_records(spark, path, "jsonl"))


@query(
    "json_broken_elements",
    f"WITH {EVENTS} SELECT k % 9 = 1 AS broken, count(*) AS n FROM ev GROUP BY 1",
)
def json_broken_elements(spark, sf):
    """Arrays with broken elements: each is a reject of its own, and all others are read."""
    path = work_path(spark, "events-broken")
    rows = records(spark, sf)
    line = F.to_json(F.struct("series_id", F.col("timestamp_raw").alias("timestamp"), F.transform_values("measurements", lambda _, v: protocols.token(v)).alias("measurements")))
    broken = F.when(q.metric("k").cast("int") % 9 == 1, F.concat(F.lit('{"series_id": },'), F.lit(""))).otherwise(F.concat(line, F.lit(",")))
    arrays = rows.select("event_id", broken.alias("line")).groupBy(F.expr("event_id div 1000")).agg(F.array_join(F.collect_list("line"), "\n").alias("lines"))
    arrays.select(F.concat(F.lit("["), F.regexp_replace("lines", ",$", ""), F.lit("]"))).write.option("maxRecordsPerFile", 1).text(path)
    read = formats.read_records(spark, path, "json")
    return read.groupBy(F.col("error").isNotNull().alias("broken")).agg(F.count("*").alias("n"))


def _columnar(spark, sf, fmt):
    path = work_path(spark, f"events-{fmt}")
    files.write_records(records(spark, sf).select("series_id", "timestamp", "measurements"), path, fmt)
    return _back(formats.read_records(spark, path, fmt))


@query("roundtrip_parquet", _BACK)
def roundtrip_parquet(spark, sf):
    return _columnar(spark, sf, "parquet")


@query("roundtrip_orc", _BACK)
def roundtrip_orc(spark, sf):
    return _columnar(spark, sf, "orc")


def _mixed(spark, sf, reader):
    """Two files of one folder, each with a column the other lacks."""
    path = work_path(spark, "mixed")
    e = events(spark, sf).select(F.col("event_type").alias("series_id"), F.col("ts").alias("timestamp"), "event_id", "value", "k")
    e.where("k < 50").drop("k").write.format(reader).save(f"{path}/one")
    e.where("k >= 50").drop("value").write.format(reader).save(f"{path}/two")
    rows = formats.read_records(spark, [f"{path}/one", f"{path}/two"], reader)
    value = lambda m: F.col("measurements")[m]["num"]
    return rows.select(
        "series_id", "timestamp", value("event_id").cast("long").alias("event_id"), value("value").alias("value"), value("k").alias("k")
    )


_MIXED = f"WITH {EVENTS} SELECT event_type AS series_id, ts AS timestamp, event_id, CASE WHEN k < 50 THEN value END AS value, CAST(CASE WHEN k >= 50 THEN k END AS DOUBLE) AS k FROM ev"


@query("parquet_mixed_columns", _MIXED)
def parquet_mixed_columns(spark, sf):
    return _mixed(spark, sf, "parquet")


@query("orc_mixed_columns", _MIXED)
def orc_mixed_columns(spark, sf):
    return _mixed(spark, sf, "orc")


@query(
    "parquet_text_measurements",
    "SELECT event_id, event_type AS kind, value, CAST(user_id + 9007199254740993 AS VARCHAR) AS big FROM events",
)
def parquet_text_measurements(spark, sf):
    """Text and a mixed column stay what they are in a columnar export."""
    e = table(spark, sf, "events")
    pair = lambda num, raw: F.struct(num.cast("double").alias("num"), raw.cast("string").alias("raw"))
    big = (F.col("user_id") + F.lit(9007199254740993)).cast("string")
    rows = e.select(
        "event_id",
        F.map_from_arrays(
            F.array(F.lit("kind"), F.lit("value"), F.lit("big")),
            F.array(pair(F.lit(None), F.col("event_type")), pair(F.col("value"), F.col("value")), pair(F.lit(None), big)),
        ).alias("measurements"),
    )
    path = work_path(spark, "text")
    files.write_parquet(rows, path)
    back = spark.read.parquet(path)
    return back.withColumnsRenamed({f"measurement_{c}": c for c in ("kind", "value", "big")})


@query(
    "json_tokens",
    "SELECT event_id, CAST(user_id + 9007199254740993 AS VARCHAR) AS big, CAST(user_id * 1000000 AS VARCHAR) AS round, "
    "CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag FROM events",
)
def json_tokens(spark, sf):
    """Integers beyond 2^53, round integers and booleans are written as they came."""
    e = table(spark, sf, "events")
    pair = lambda raw: F.struct(F.coalesce(raw.try_cast("double"), F.lit(1.0)).alias("num"), raw.alias("raw"))
    big = (F.col("user_id") + F.lit(9007199254740993)).cast("string")
    flag = F.when(F.col("user_id") % 2 == 0, F.lit("true")).otherwise(F.lit("false"))
    rows = e.select(
        "event_id",
        F.map_from_arrays(
            F.array(F.lit("big"), F.lit("round"), F.lit("flag")),
            F.array(pair(big), pair((F.col("user_id") * 1000000).cast("string")), pair(flag)),
        ).alias("measurements"),
    )
    path = work_path(spark, "tokens")
    files.write_json(rows, path)
    line = spark.read.text(path)
    take = lambda name: F.regexp_extract("value", f'"{name}":([^,}}]*)', 1)
    return line.select(
        take("event_id").cast("long").alias("event_id"), take("big").alias("big"), take("round").alias("round"), take("flag").alias("flag")
    )


@query("roundtrip_arrow", _BACK)
def roundtrip_arrow(spark, sf):
    return _columnar(spark, sf, "arrow")


def _protocol(spark, sf, fmt, reader=None):
    path = work_path(spark, f"events-{fmt}")
    files.write_records(records(spark, sf), path, fmt)
    return rec.split(formats.read_records(spark, path, reader or fmt)).accepted


@query("roundtrip_line_protocol", _BACK)
def roundtrip_line_protocol(spark, sf):
    return _back(_protocol(spark, sf, "influxdb"))


@query(
    "line_protocol_long_fields",
    "SELECT CAST(doc_id AS VARCHAR) AS series_id, length(t) AS n, sha256(t) AS digest FROM ("
    "SELECT doc_id, repeat(replace(replace(text, chr(10), ' '), chr(13), ' '), 20) AS t FROM documents)",
)
def line_protocol_long_fields(spark, sf):
    """Fields of up to hundreds of kilobytes are read as written."""
    docs = table(spark, sf, "documents")
    quoted = F.repeat(F.regexp_replace(F.translate("text", "\n\r", "  "), r'(["\\])', r"\\$1"), F.lit(20))
    line = F.concat(F.lit("docs,series_id="), F.col("doc_id").cast("string"), F.lit(' text="'), quoted, F.lit('" 1'))
    read = protocol_sources.line_protocol_records(docs.select(line.alias("value")))
    raw = F.col("measurements")["text"]["raw"]
    return read.select("series_id", F.length(raw).cast("long").alias("n"), F.sha2(raw, 256).alias("digest"))


@query("roundtrip_questdb", _BACK)
def roundtrip_questdb(spark, sf):
    return _back(_protocol(spark, sf, "questdb"))


@query(
    "roundtrip_opentsdb",
    f"WITH {EVENTS}, {_LONG} SELECT event_type AS series_id, date_trunc('second', ts) AS timestamp, m AS measurement, x AS value FROM long",
)
def roundtrip_opentsdb(spark, sf):
    return reshape.unpivot_long(_protocol(spark, sf, "opentsdb").drop("metadata"))


@query(
    "roundtrip_prometheus",
    f"WITH {EVENTS}, {_LONG} SELECT event_type AS series_id, date_trunc('millisecond', ts) AS timestamp, m AS measurement, x AS value FROM long",
)
def roundtrip_prometheus(spark, sf):
    return reshape.unpivot_long(_protocol(spark, sf, "prometheus").drop("metadata"))


@query(
    "roundtrip_stooq",
    f"WITH {BARS} SELECT ticker AS series_id, timestamp, {r('open', 2)} AS open, {r('close', 2)} AS close, CAST(vol AS DOUBLE) AS vol, 'D' AS period FROM bars",
)
def roundtrip_stooq(spark, sf):
    path = work_path(spark, "bars-stooq")
    files.write_records(bar_records(spark, sf), path, "stooq")
    got = rec.split(formats.read_records(spark, path, "txt")).accepted
    return got.select(
        "series_id", "timestamp", rounded(q.metric("open"), 2).alias("open"), rounded(q.metric("close"), 2).alias("close"),
        q.metric("vol").alias("vol"), F.col("measurements")["period"]["raw"].alias("period"),
    )


@query("convert_csv_to_jsonl", f"WITH {BARS} SELECT ticker AS series_id, timestamp, open, close, CAST(vol AS DOUBLE) AS vol FROM bars")
def convert_csv_to_jsonl(spark, sf):
    source, target = work_path(spark, "bars.csv"), work_path(spark, "bars.jsonl")
    text = bars(spark, sf).drop("o_orderkey").withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd"))
    text.withColumnRenamed("vol", "volume").write.option("header", True).csv(source)
    jobs.convert(spark, source, target)
    got = rec.split(formats.read_records(spark, target)).accepted
    return got.select("series_id", "timestamp", *[q.metric(m).alias(m) for m in ("open", "close", "vol")])


@query("csv_to_parquet", "SELECT c_custkey::BIGINT AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_to_parquet(spark, sf):
    source, target = work_path(spark, "customer.csv"), work_path(spark, "customer.parquet")
    table(spark, sf, "customer").write.option("header", True).csv(source)
    jobs.csv_to_parquet(spark, source, target, "zstd")
    return spark.read.parquet(target).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))
