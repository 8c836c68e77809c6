"""Readers, writers and record rules on small files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell import schema
from tidewell.functions import tokens
from tidewell.operators import records as rec
from tidewell.plans import jobs
from tidewell.sinks import files, protocols
from tidewell.sources import delimited, formats, payload, text


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.write_text(content)
        return str(path)

    return write


def numbers(row, part="num"):
    return {k: v[part] if v else None for k, v in row["measurements"].items()}


def by_series(df):
    return {r["series_id"]: r for r in df.collect()}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2024-01-05T06:07:08", dt.datetime(2024, 1, 5, 6, 7, 8)),
        ("2024-01-05T06:07:08.25", dt.datetime(2024, 1, 5, 6, 7, 8, 250000)),
        ("2024-01-05T06:07:08Z", dt.datetime(2024, 1, 5, 6, 7, 8)),
        ("2024-1-5", dt.datetime(2024, 1, 5)), ("20240105", dt.datetime(2024, 1, 5)),
        ("2024115", dt.datetime(2024, 11, 5)), ("2024-02-30", None), ("13/02/2024", None), ("2024", None), ("", None),
    ],
)
def test_ingest_timestamps(spark, raw, want):
    row = spark.createDataFrame([(raw,)], "t string").select(tokens.parse_timestamp(F.col("t"))).first()
    assert row[0] == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("13/02/2024", dt.datetime(2024, 2, 13)), ("02/13/2024", dt.datetime(2024, 2, 13)),
        ("01-02-2024", dt.datetime(2024, 2, 1)), ("2024/3/4", dt.datetime(2024, 3, 4)),
        ("20240305060708", dt.datetime(2024, 3, 5, 6, 7, 8)), ("row_7", None), ("31/31/2024", None),
    ],
)
def test_loose_dates(spark, raw, want):
    row = spark.createDataFrame([(raw,)], "t string").select(tokens.parse_loose(F.col("t"))).first()
    assert row[0] == want


@pytest.mark.parametrize(
    ("token", "num", "raw"),
    [
        (" 5 ", 5.0, "5"), ("5.0", 5.0, "5.0"), ("1e5", None, "1e5"), ("1.5e3", 1500.0, "1500.0"),
        ("nan", None, "nan"), ("abc", None, "abc"), ("-3", -3.0, "-3"),
    ],
)
def test_tokens(spark, token, num, raw):
    row = spark.createDataFrame([(token,)], "t string").select(tokens.token_value(F.col("t")).alias("v")).first()
    assert (row["v"]["num"], row["v"]["raw"]) == (num, raw)


def test_empty_token_is_null(spark):
    row = spark.createDataFrame([(" ",)], "t string").select(tokens.token_value(F.col("t")).alias("v")).first()
    assert row["v"] is None


def test_csv_roles_rejects_and_volume(spark, put):
    path = put("a.csv", 'ticker,date,open,volume,x\nA,2024-01-01,1,5,1e5\nB,2024-01-02,2,3,9,9\n"D,d",2024-01-04,4.50,7,2.0\n')
    rows = by_series(rec.check_canonical(text.read_csv(spark, path)))
    assert numbers(rows["A"]) == {"x": None, "open": 1.0, "vol": 5.0}
    assert rows["B"]["error"] == "Row is longer than the header"
    assert rows["D,d"]["error"] is None


def test_csv_empty_cell_is_reported(spark, put):
    row = rec.check_canonical(text.read_csv(spark, put("a.csv", "series_id,timestamp,x\nA,2024-01-01,\n"))).first()
    assert row["error"] == "Measurement 'x' must be a number or string"


def _record(i, pad=""):
    return f'{{"series_id":"s{i}","timestamp":"2024-01-01","note":"{pad}","measurements":{{"v":{i}}}}}'


def test_json_layout_is_per_file_and_nothing_is_lost(spark, tmp_path):
    contents = {
        "broken first.json": f"{{bad\n{_record(1)}\n{_record(2)}",
        "array[1].json": f"[{_record(3)},\n{_record(4)}]",
        "lines.json": f"{_record(5)}\n{{oops\n{_record(6)}",
        "cut.json": f"[{_record(7)},\n{_record(8)[:-9]}",
    }
    for name, content in contents.items():
        (tmp_path / name).write_text(content)
    rows = text.read_json(spark, str(tmp_path)).collect()
    assert sorted(r["series_id"] for r in rows if not r["error"]) == [f"s{i}" for i in range(1, 8)]
    assert [r["error"] for r in rows if r["error"]] == ["Invalid JSON"] * 3


def test_json_array_above_the_size_of_a_variant(spark, tmp_path):
    path, pad = tmp_path / "big.json", "x" * 100_000
    with path.open("w") as out:
        for i in range(1400):
            out.write(("," if i else "[") + _record(i, pad))
        out.write("]")
    assert path.stat().st_size > 128 << 20
    good = rec.split(text.read_json(spark, str(path))).accepted
    assert good.select("series_id").distinct().count() == 1400


def test_csv_files_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a [1].csv").write_text("ticker,date,open,close\nA,2024-01-01,1,2\n")
    (tmp_path / "b.csv").write_text("ticker,date,close,open\nB,2024-01-01,2,1\n")
    (tmp_path / "c.csv").write_text("x,series_id,timestamp\n7,C,2024-01-01\n")
    rows = by_series(rec.check_canonical(text.read_csv(spark, str(tmp_path))))
    assert numbers(rows["A"]) == numbers(rows["B"]) == {"open": 1.0, "close": 2.0}
    assert numbers(rows["C"]) == {"x": 7.0} and not any(r["error"] for r in rows.values())


def test_stooq_files_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text("TICKER,PER,DATE,TIME,OPEN,CLOSE\nA,D,20240101,000000,1,2\n")
    (tmp_path / "b.txt").write_text("TICKER,PER,DATE,TIME,CLOSE,OPEN\nB,D,20240101,000000,2,1\n")
    rows = by_series(formats.read_records(spark, str(tmp_path), "stooq"))
    assert [(numbers(r)["open"], numbers(r)["close"]) for r in (rows["A"], rows["B"])] == [(1.0, 2.0)] * 2


def test_csv_without_header(spark, put):
    rows = by_series(text.read_csv(spark, put("a.csv", "A,2024-01-01,1,z\nB,2024-01-02\nC\n"), header=False))
    assert set(rows) == {"A", "B"}
    assert numbers(rows["A"], "raw") == {"measurement_0": "1", "measurement_1": "z"}


def test_jsonl_keeps_good_lines(spark, put):
    path = put("a.jsonl", '{"series_id":"a","timestamp":"2024-01-01","measurements":{"x":1}}\n\n{bad\n')
    parts = rec.split(text.read_jsonl(spark, path))
    assert parts.accepted.count() == 1
    assert [r["error"] for r in parts.rejected.collect()] == ["Invalid JSON"]


@pytest.mark.parametrize(
    ("content", "n"),
    [
        ('[{"series_id":"a","timestamp":"x","measurements":{"v":1}},\n{"series_id":"b","timestamp":"x","measurements":{"v":1}}]', 2),
        ('{\n"series_id":"a","timestamp":"x","measurements":{"v":1}}', 1), ("7", 0), ("[", 0),
    ],
)
def test_json_shapes(spark, put, content, n):
    assert text.read_json(spark, put("a.json", content)).count() == n


@pytest.mark.parametrize(
    ("line", "separator"),
    [("a,b;c", ","), ("a;b", ";"), ("a|b|c", r"\|"), ("a\tb", "\\\t"), ("a b  c", r"\s+"), ("a", ",")],
)
def test_separators(line, separator):
    assert delimited.pick_separator(line) == separator


def test_delimited_repairs_a_missing_period(spark, put):
    path = put("a.txt", "<TICKER>;<DATE>;<OPEN>;<ADJ CLOSE>;Foo Bar\nA;D;13/02/2024;1;2;x\n")
    row = delimited.read_delimited(spark, path).first()
    assert row["timestamp"] == dt.datetime(2024, 2, 13)
    assert numbers(row, "raw") == {"per": "D", "open": "1", "close": "2", "foo_bar": "x"}


def test_delimited_without_dates_numbers_the_lines(spark, put):
    got = delimited.read_delimited(spark, put("d.txt", "1 5 7\n\n2 x 9\n")).collect()
    assert sorted((r["series_id"], r["timestamp_raw"]) for r in got) == [("d", "row_0"), ("d", "row_2")]


def test_line_numbers_across_blocks(spark, put):
    """The same numbers however the file is split."""
    path = put("n.txt", "".join(f"{i} {i * 2}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 1
        got = delimited.read_delimited(spark, path)
        pairs = {(r["timestamp_raw"], r["measurements"]["value_1"]["num"]) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert pairs == {(f"row_{i}", i * 2.0) for i in range(3000)}


def test_stooq(spark, put):
    path = put("s.txt", "TICKER,PER,DATE,TIME,OPEN,HIGH,LOW,CLOSE,VOL,OPENINT\nA.US,D,20240105,0930,1,2,0.5,x,10.7,0\nB,5,20240199,153000,1,2,3,4,5,6\n")
    rows = by_series(formats.read_records(spark, path))
    assert rows["A.US"]["timestamp"] == dt.datetime(2024, 1, 5)
    assert numbers(rows["A.US"]) == {"open": 1.0, "high": 2.0, "low": 0.5, "vol": 10.0, "openint": 0.0, "period": None}
    assert rows["B"]["error"] == "Invalid date or time"


def record(spark, **measurements):
    values = {
        k: schema.text_value(F.lit(v)) if isinstance(v, str) else schema.number_value(F.lit(v)) for k, v in measurements.items()
    }
    return spark.range(1).select(
        F.lit("my series,x").alias("series_id"),
        F.lit("2024-01-05 00:00:00.123456").cast("timestamp").alias("timestamp"),
        F.lit("2024-01-05T00:00:00.123456").alias("timestamp_raw"),
        schema.measurement_map(values).alias("measurements"),
        schema.string_map({"host": F.lit("h 1")}).alias("metadata"),
        F.lit("x").alias("format"),
    )


def test_line_protocol_escapes_and_types(spark):
    line = protocols.line_protocol(record(spark, v=1, ok=True, t='a "b"')).first()[0]
    assert line == 'my\\ series\\,x v=1,ok=true,t="a \\"b\\"" 1704412800123456000'


def test_questdb_and_opentsdb(spark):
    row = record(spark, v=1.5, t="hello")
    assert protocols.questdb_lines(row, "tab").first()[0].startswith("tab,series_id=my\\ series\\,x,host=h\\ 1 v=1.5")
    assert sorted(r[0] for r in protocols.opentsdb_lines(row).collect()) == [
        "put my_series,x.t 1704412800 0 t=hello host=h_1", "put my_series,x.v 1704412800 1.5 host=h_1",
    ]


def test_line_protocol_round_trip(spark, tmp_path):
    original = record(spark, v=1.5, t='he said "x=1, y"', ok=True)
    files.write_records(original, str(tmp_path / "o"), "influxdb")
    back = formats.read_records(spark, str(tmp_path / "o"), "influxdb").first()
    assert back["series_id"] == "my series,x"
    assert back["timestamp"] == dt.datetime(2024, 1, 5, 0, 0, 0, 123456)
    assert numbers(back, "raw") == {"v": "1.5", "t": 'he said "x=1, y"', "ok": "true"}


def test_sql_text_doubles_quotes(spark):
    row = record(spark, v=1e7).withColumn("series_id", F.lit("o'x"))
    assert "'o''x', 'v', 10000000.0, " in protocols.timescale_lines(row).first()[0]
    assert protocols.tdengine_lines(row).first()[0].endswith("VALUES ('2024-01-05 00:00:00.123', 'o''x', 10000000.0);")


@pytest.mark.parametrize("x", [0.125, 0.375, 2.675, 1.005, 1.115, -2.675, -3.14159, 1e16, 0.0, 99.995, 12345678.905])
def test_two_decimals(spark, x):
    assert spark.range(1).select(tokens.two_decimals(F.lit(x))).first()[0] == f"{x:.2f}"


def test_stooq_export_falls_back(spark):
    row = protocols.stooq_rows(record(spark, o=0.0, OPEN=3.5, c="n/a", Volume=12.9)).first()
    assert (row["OPEN"], row["CLOSE"], row["VOL"], row["OPENINT"], row["PER"]) == ("3.50", "n/a", "12", "0", "D")


def test_payload_paths(spark, put):
    read = lambda s, p: [r[0].toPython() for r in payload.extract_records(payload.read_responses(spark, put("r.json", s)), p).collect()]
    assert read('{"results":[{"a":1}]}', "data") == [{"a": 1}]
    assert read("[1,2]", "") == [1, 2]
    assert read('{"a":{"b":{"z":2}}}', "a.b") == [{"z": 2}]
    assert read('{"a":1}', "a.b") == []


def test_unreadable_responses_are_rejects(spark, tmp_path):
    for name, content in {"a": '{"data": [1, 2]}', "b": '{"data": [1,', "c": "null", "d": "[]"}.items():
        (tmp_path / f"{name}.json").write_text(content)
    responses = payload.read_responses(spark, str(tmp_path))
    found = payload.extract_records(responses)
    assert found.columns == ["record", "source_file"] and found.count() == 2
    bad = payload.rejected_responses(responses).collect()
    assert [(r.source_file.rsplit("/", 1)[1], r.error) for r in bad] == [("b.json", payload.UNREADABLE)]


@pytest.mark.parametrize(
    ("size", "text"),
    [(0, "0 B"), (1023, "1023 B"), (1152, "1.12 KB"), (1408, "1.38 KB"), (1 << 20, "1.00 MB"), (5 << 30, "5.00 GB"), (None, "N/A")],
)
def test_byte_size(spark, size, text):
    assert spark.range(1).select(tokens.byte_size(F.lit(size).cast("long"))).first()[0] == text


def test_formats():
    assert formats.detect_format("in/a.CSV") == "csv"
    assert formats.detect_format("a.json.gz") == "json"
    assert formats.detect_format("a.unknown") is None
    assert len(formats.FORMATS) == 33 and len(formats.EXTENSIONS) == 42
    assert jobs.can_convert("csv", "influxdb") and not jobs.can_convert("csv", "xlsx")
    assert "influxdb" in jobs.supported_formats()["tsdb"]


def test_empty_input_is_refused(spark, tmp_path):
    with pytest.raises(files.NothingToWrite):
        files.write_records(record(spark, v=1).limit(0), str(tmp_path / "o"), "csv")


def test_csv_to_table_modes(spark, put):
    path = put("t.csv", "a,b\n1,2\n3,4\n")
    spark.sql("DROP TABLE IF EXISTS tidewell_t")
    try:
        assert jobs.csv_to_table(spark, path, "tidewell_t") == 2
        assert jobs.csv_to_table(spark, path, "tidewell_t", if_exists="append") == 4
        with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
            jobs.csv_to_table(spark, path, "tidewell_t", if_exists="fail")
    finally:
        spark.sql("DROP TABLE IF EXISTS tidewell_t")


def test_accepted_and_rejected_cover_the_input(spark, put):
    lines = ['{"series_id":"a","timestamp":"t","measurements":{"x":%d}}' % i for i in range(50)] + ["[]", "{}", "x"]
    read = text.read_jsonl(spark, put("a.jsonl", "\n".join(lines)))
    parts = rec.split(read)
    assert (parts.accepted.count(), parts.rejected.count(), read.count()) == (50, 3, 53)


def test_delimited_files_are_read_by_their_own_layout(spark, tmp_path):
    (tmp_path / "a.txt").write_text("SYMBOL;DATE;OPEN;CLOSE\nA;2024-01-01;1;2\n")
    (tmp_path / "b.txt").write_text("DATE\tCLOSE\tOPEN\tSYMBOL\tNote\n2024-01-02\t4\t3\tB\tx\n\nDATE\tCLOSE\tOPEN\tSYMBOL\tNote\n")
    (tmp_path / "c.txt").write_text("7 8\n\n9 10\n")
    (tmp_path / "s.txt").write_text("TICKER,PER,DATE,TIME,OPEN,HIGH,LOW,CLOSE,VOL,OPENINT\nS,D,20240103,000000,5,6,4,5.5,10,0\n")
    rows = delimited.read_delimited(spark, str(tmp_path)).collect()
    got = {(r["series_id"], r["timestamp_raw"][:10]): {k: v for k, v in numbers(r, "raw").items() if v is not None} for r in rows}
    assert got[("A", "2024-01-01")] == {"open": "1", "close": "2"}
    assert got[("B", "2024-01-02")] == {"open": "3", "close": "4", "note": "x"}
    assert got[("c", "row_0")] == {"value_1": "8"} and got[("c", "row_2")] == {"value_1": "10"}
    assert got[("S", "2024-01-03")]["close"] == "5.5"
    assert len(rows) == 5


def test_csv_of_many_headers_is_one_branch(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"{k:03}.csv").write_text(f'm{k},ticker,date,Close\n{k},T{k},2024-01-01,{k}.5\n"x, y",T{k},2024-01-02,1,2\n')
    read = text.read_csv(spark, str(tmp_path))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    rows = rec.check_canonical(read).collect()
    good = {r["series_id"]: numbers(r) for r in rows if not r["error"]}
    assert good == {f"T{k}": {f"m{k}": float(k), "close": k + 0.5} for k in range(60)}
    assert [r["error"] for r in rows if r["error"]] == ["Row is longer than the header"] * 60


def test_csv_columns_that_differ_in_case(spark, put):
    rows = by_series(rec.check_canonical(text.read_csv(spark, put("a.csv", "ticker,date,Open,close,open\nA,2024-01-01,1,2,3\n"))))
    assert numbers(rows["A"]) == {"open": 3.0, "close": 2.0}
