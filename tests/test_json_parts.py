"""Arrays that many tasks read, broken elements, and text behind a value."""

import json
import random

import pytest

from tidewell.operators import records as rec
from tidewell.sources import json_parts, text


def nasty(pick):
    parts = ["{", "}", "[", "]", '"', "\\", ",", "a", "é", "\n", "},{", "\\\"", ' "x": {']
    note = lambda: "".join(pick.choices(parts, k=pick.randrange(12)))
    inner = [note(), {"deep": [note(), {"er": note()}]}, pick.randrange(9), None, []]
    return {
        "series_id": note() or "s", "timestamp": "2024-01-01", "measurements": {"v": pick.randrange(99), "t": note()}, "metadata": {"n": note()},
        "other": pick.choice(inner),
    }


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


@pytest.mark.parametrize("indent", [None, 1])
def test_elements_of_many_blocks(spark, tmp_path, small_blocks, indent):
    pick = random.Random(indent)
    wanted = [nasty(pick) for _ in range(25)]
    (tmp_path / "all.json").write_text("﻿ \n" + json.dumps(wanted, indent=indent, ensure_ascii=False) + "\n")
    one = nasty(pick)
    (tmp_path / "one.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "none.json").write_text("[ ]\n")
    pieces = json_parts.read_pieces(spark, str(tmp_path))
    assert pieces.select("block").distinct().count() > 3
    kinds = json_parts.kinds_of(pieces).where("kind <> 'lines'")
    found = json_parts.elements(pieces.join(kinds, "source_file")).collect()
    got = {name: sorted(r.body for r in found if name in r.source_file) for name in ("all", "one")}
    assert sorted(map(json.dumps, map(json.loads, got["all"]))) == sorted(map(json.dumps, wanted))
    assert [json.loads(x) for x in got["one"]] == [one]
    assert len(found) == 26 and not any(r.broken for r in found)
    assert rec.split(text.read_json(spark, str(tmp_path))).accepted.count() == 26


def record(k):
    return json.dumps({"series_id": f"s{k}", "timestamp": "2024-01-01", "measurements": {"v": k}})


@pytest.mark.parametrize(
    ("content", "good", "bad"),
    [
        (f"[{record(0)}, {{\"series_id\": }}, {record(1)}]", 2, 1),
        (f"[{record(0)}, {{\"a\": {{\"b\": 1}}, {record(1)}, {record(2)}]", 3, 1),
        (f"[{record(0)}, {record(1)}}}, {record(2)}, {record(3)}]", 4, 1),
        (f"[{record(0)},\n{{\"a\": \"open}},\n{record(1)},\n{record(2)}]", 3, 1),
        (f"[{record(0)}, 7, \"x\", {record(1)}, [1]]", 2, 3),
        (f"[{record(0)}, {record(1)}", 2, 0),
        (f"[{record(0)}, {record(1)}] {record(2)}", 2, 1),
    ],
)
def test_what_stands_around_a_broken_element(spark, tmp_path, content, good, bad):
    (tmp_path / "a.json").write_text(content)
    rows = text.read_json(spark, str(tmp_path)).collect()
    assert (sum(r.error is None for r in rows), sum(r.error is not None for r in rows)) == (good, bad)
    assert len({r.series_id for r in rows if r.error is None}) == good


@pytest.mark.parametrize(
    ("tail", "error"),
    [("", None), ("  ", None), (" junk", "Invalid JSON"), (record(2), "Invalid JSON"), ("," + record(2), "Invalid JSON"), ("]", "Invalid JSON"),
     ("}", "Invalid JSON"), (',"end of text"', "Invalid JSON"), (',"end of text"]', "Invalid JSON")],
)
def test_a_line_is_one_value(spark, tmp_path, tail, error):
    (tmp_path / "a.jsonl").write_text(record(1) + tail + "\n")
    rows = text.read_jsonl(spark, str(tmp_path)).collect()
    assert [r.error for r in rows] == [error]
