"""Conversations brought back to turns that alternate, by the cheapest edits.

What a dialogue needs next has four states. A row, or any stretch of rows, is a table of the cheapest way from
each state to each; tables of neighbouring stretches combine. The edits are found by divide and conquer: a
cost vector from the front and one from the back meet in the middle, the best crossing fixes the state there,
and both halves follow in the same way, so that only vectors are kept. Long conversations are cut into blocks:
the crossings between blocks are found first, then those inside each block, all blocks at once.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import written

#: rows of a conversation that one call solves, and blocks that one call joins
BLOCK_ROWS, BLOCKS_JOINED = 4096, 1024
#: nothing yet; after the system turn; a user turn is open; a pair is complete
STATES = range(4)
NEEDS, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: inserts after the last row until the dialogue may end
CLOSING = (0, 2, 1, 0)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}

_TOKEN = re.compile("([suao])([ktbd])([0-9]*)")


class Table(NamedTuple):
    """From each state (outer) to each (inner): least cost, None if there is no way, and the order of the ways.

    ``order`` sorts the cheapest ways from one state by their edits. No way is the beginning of another, as each
    ends with the edit of the last row; so the order still holds when further edits follow.
    """

    cost: list[list[int | None]]
    order: list[list[int]]


def _row_table(role: str, truncated: bool) -> tuple[Table, list[list[str]]]:
    """The ways of one row that may stay, and their edits: inserts before it, then the edit of the row."""
    costs, orders, edits = [], [], []
    for state in STATES:
        ways = {state: (DELETE, "D")}
        at = state
        for inserts in range(3):
            base, before = INSERT * inserts + TRUNCATED * truncated, "I" * inserts
            own = [(REROLE, "R", AFTER[at])]
            if role == NEEDS[at][0]:
                own.append((0, "K", AFTER[at]))
            if role == "s" and at == 0:
                own.append((0, "K", 1))
            for cost, edit, to in own:
                ways[to] = min(ways.get(to, (1 << 60, "")), (base + cost, before + edit))
            at = AFTER[at]
        names = sorted(w for _, w in ways.values())
        costs.append([ways[to][0] if to in ways else None for to in STATES])
        orders.append([names.index(ways[to][1]) if to in ways else 0 for to in STATES])
        edits.append([ways[to][1] if to in ways else "" for to in STATES])
    return Table(costs, orders), edits


_ROWS = {role + fault: _row_table(role, fault == "t") for role in "suao" for fault in "kt"}


@functools.lru_cache(maxsize=4096)
def _deletions(n: int) -> Table:
    """``n`` rows that must go; an insert among them can as well stand after them, where it sorts first."""
    return Table([[DELETE * n if a == b else None for b in STATES] for a in STATES], [[0] * 4 for _ in STATES])


def _forward(vector: list, table: Table) -> list:
    """(cost, order) of each state after the stretch, given those before it."""
    best: list = [None] * 4
    for a in STATES:
        if vector[a] is not None:
            cost, order = vector[a]
            for b in STATES:
                step = table.cost[a][b]
                if step is not None:
                    way = (cost + step, order, table.order[a][b])
                    if best[b] is None or way < best[b]:
                        best[b] = way
    ranks = sorted(w[1:] for w in best if w is not None)
    return [None if w is None else (w[0], ranks.index(w[1:])) for w in best]


def _backward(vector: list, table: Table) -> list:
    """Least cost from each state before the stretch, given those after it."""
    out = []
    for a in STATES:
        ways = [table.cost[a][b] + vector[b] for b in STATES if vector[b] is not None and table.cost[a][b] is not None]
        out.append(min(ways, default=None))
    return out


def combined(tables: list[Table]) -> Table:
    """The table of all the stretches in a row."""
    costs, orders = [], []
    for state in STATES:
        vector: list = [(0, 0) if s == state else None for s in STATES]
        for table in tables:
            vector = _forward(vector, table)
        costs.append([None if w is None else w[0] for w in vector])
        orders.append([0 if w is None else w[1] for w in vector])
    return Table(costs, orders)


def crossings(tables: list[Table], start: int, end: int) -> list[int]:
    """The states before, between and after the stretches, on the cheapest way whose edits sort first."""
    states = [start] + [end] * len(tables)

    def meet(low: int, high: int) -> None:
        if high - low < 2:
            return
        middle = (low + high) // 2
        front: list = [(0, 0) if s == states[low] else None for s in STATES]
        for k in range(low, middle):
            front = _forward(front, tables[k])
        back: list = [0 if s == states[high] else None for s in STATES]
        for k in range(high - 1, middle - 1, -1):
            back = _backward(back, tables[k])
        ways = [(front[s][0] + back[s], front[s][1], s) for s in STATES if front[s] is not None and back[s] is not None]
        states[middle] = min(ways)[2]
        meet(low, middle)
        meet(middle, high)

    meet(0, len(tables))
    return states


def ending(table: Table) -> tuple[int, int, int]:
    """(cost, last state, inserts at the end) of a whole conversation."""
    cost, order = table.cost[0], table.order[0]
    best = min((cost[s] + INSERT * CLOSING[s], order[s], s) for s in STATES if cost[s] is not None)
    return best[0], best[2], CLOSING[best[2]]


def _stretches(tokens: str) -> list[tuple[int, str, Table, int]]:
    """(row, kind, table, copies): a row that may stay, kind its class; or copies that must go, kind empty."""
    out = []
    for at, (role, fault, n) in enumerate(_TOKEN.findall(tokens)):
        copies = int(n or 1)
        if fault in "kt":
            out.append((at, role + fault, _ROWS[role + fault][0], 1))
            copies -= 1
        if copies:
            out.append((at, "", _deletions(copies), copies))
    return out


@functools.lru_cache(maxsize=1 << 14)
def block_table(tokens: str) -> tuple[Table, int]:
    """The table of a block, and how many of its neighbouring rows do not follow each other."""
    illegal, last = 0, ""
    for role, _, n in _TOKEN.findall(tokens):
        illegal += int(n or 1) - 1 + (last != "" and last + role not in LEGAL)
        last = role
    return combined([t for _, _, t, _ in _stretches(tokens)]), illegal


@functools.lru_cache(maxsize=1 << 14)
def block_edits(tokens: str, start: int, end: int, closing: int) -> list[dict]:
    """The edits of a block in order, between two known states, with the inserts that follow it."""
    stretches = _stretches(tokens)
    states = crossings([t for _, _, t, _ in stretches], start, end)
    out: list[dict] = []

    def add(at: int, edit: str, copies: int, role: str | None) -> None:
        out.append({"at": at, "step": len(out), "edit": edit, "copies": copies, "role": role})

    for (at, kind, _, copies), state, after in zip(stretches, states, states[1:], strict=False):
        if not kind:
            add(at, "D", copies, None)
            continue
        for edit in _ROWS[kind][1][state][after]:
            add(at, edit, 1, NEEDS[state] if edit in "IR" else None)
            state = AFTER[state] if edit == "I" else state
    at, state = stretches[-1][0], states[-1]
    for _ in range(closing):
        add(at, "I", 1, NEEDS[state])
        state = AFTER[state]
    return out


_TABLE = "cost array<array<long>>, order array<array<int>>, illegal long"
_ARROW = [("cost", pa.list_(pa.list_(pa.int64()))), ("order", pa.list_(pa.list_(pa.int32()))), ("illegal", pa.int64())]


def _tables():
    def run(tokens: pa.Array) -> pa.Array:
        found = (block_table(t) for t in tokens.to_pylist())
        return pa.array([{"cost": t.cost, "order": t.order, "illegal": n} for t, n in found], pa.struct(_ARROW))

    return F.arrow_udf(run, _TABLE)


def _joined():
    def run(parts: pa.Array) -> pa.Array:
        out = []
        for own in parts.to_pylist():
            table = combined([Table(p["cost"], p["order"]) for p in own])
            seams = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(own, own[1:], strict=False))
            out.append({"cost": table.cost, "order": table.order, "illegal": seams + sum(p["illegal"] for p in own)})
        return pa.array(out, pa.struct(_ARROW))

    return F.arrow_udf(run, _TABLE)


def _endings():
    kind = pa.struct([("cost", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("closing", pa.int32())])

    def run(cost: pa.Array, order: pa.Array) -> pa.Array:
        found = (ending(Table(c, o)) for c, o in zip(cost.to_pylist(), order.to_pylist(), strict=True))
        return pa.array([{"cost": c, "start": 0, "end": s, "closing": k} for c, s, k in found], kind)

    return F.arrow_udf(run, "cost long, start int, end int, closing int")


def _between():
    kind = pa.list_(pa.struct([("place", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("closing", pa.int32())]))

    def run(parts: pa.Array, start: pa.Array, end: pa.Array, closing: pa.Array) -> pa.Array:
        out = []
        for own, a, b, k in zip(parts.to_pylist(), start.to_pylist(), end.to_pylist(), closing.to_pylist(), strict=True):
            states = crossings([Table(p["cost"], p["order"]) for p in own], a, b)
            out.append(
                [
                    {"place": p["place"], "start": x, "end": y, "closing": k if p is own[-1] else 0}
                    for p, x, y in zip(own, states, states[1:], strict=False)
                ]
            )
        return pa.array(out, kind)

    return F.arrow_udf(run, "array<struct<place: long, start: int, end: int, closing: int>>")


def _edits():
    kind = pa.list_(
        pa.struct([("at", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("copies", pa.int64()), ("role", pa.string())])
    )

    def run(tokens: pa.Array, start: pa.Array, end: pa.Array, closing: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (tokens, start, end, closing)), strict=True)
        return pa.array([block_edits(*r) for r in rows], kind)

    return F.arrow_udf(run, "array<struct<at: long, step: int, edit: string, copies: long, role: string>>")


class Repair(NamedTuple):
    edits: DataFrame
    summary: DataFrame


_KEY = ["conv", "turn", "role", "content"]


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join where the keys are equal or both null; the keys of ``left`` stay."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_{k}" for k in keys])


def _ordered(rows: DataFrame) -> DataFrame:
    """Equal rows once with their number, their fault as a token, and a running number along the order of turns."""
    text = F.col("text")
    marked = rows.select(
        *_KEY,
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open_end"),
    )
    counted = marked.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.max("blank").alias("blank"), F.max("open_end").alias("open_end")
    )
    counted = counted.withColumn("when", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn")))
    first = counted.groupBy("conv", "role", "content").agg(F.min("when").alias("first"))
    initial = F.substring("role", 1, 1)
    fault = (
        F.when(F.col("blank"), "b").when(~F.col("when").eqNullSafe(F.col("first")), "d").when(F.col("open_end"), "t").otherwise("k")
    )
    tokens = _same(counted, first, ["conv", "role", "content"]).select(
        *_KEY,
        "n",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        fault.alias("fault"),
    )
    sort = [F.asc_nulls_first(c) for c in _KEY]
    placed = tokens.repartitionByRange(*sort).sortWithinPartitions(*sort)
    return written(placed.withColumn("seq", F.monotonically_increasing_id()), "turn_order")


def _blocks(ordered: DataFrame) -> DataFrame:
    """One row per stretch of up to ``BLOCK_ROWS`` rows of a conversation, numbered along the conversation.

    The running numbers of one conversation are without gaps inside a partition of the order, so the first
    number of a block and a place in it give the row.
    """
    copies = F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise("")
    n, fault = F.col("n"), F.col("fault")
    row = F.struct("seq", F.concat("initial", "fault", copies).alias("token"), "initial")
    blocks = ordered.groupBy("conv", F.expr(f"seq div {BLOCK_ROWS}").alias("block")).agg(
        F.array_sort(F.collect_list(row)).alias("rows"),
        F.sum(F.when(fault == "b", n).otherwise(0)).alias("blank"),
        F.sum(F.when(fault == "d", n).when(fault == "b", 0).otherwise(n - 1)).alias("duplicate"),
        F.sum(F.when(fault == "t", 1).otherwise(0)).alias("truncated"),
    )
    place = F.row_number().over(Window.partitionBy("conv").orderBy("block")).cast("long") - 1
    solved = blocks.withColumns(
        {
            "tokens": F.array_join(F.transform("rows", lambda r: r["token"]), ""),
            "from_seq": F.get("rows", F.lit(0))["seq"],
            "first": F.get("rows", F.lit(0))["initial"],
            "last": F.element_at("rows", -1)["initial"],
            "place": place,
        }
    ).drop("rows")
    return written(solved.withColumn("table", _tables()("tokens")).select("*", "table.*").drop("table", "block"), "blocks")


_COUNTS = ("blank", "duplicate", "truncated")


def _joined_blocks(level: DataFrame) -> DataFrame:
    """``BLOCKS_JOINED`` neighbours as one, which keeps them as ``parts``."""
    part = F.struct("place", "cost", "order", "illegal", "first", "last")
    up = level.groupBy("conv", F.expr(f"place div {BLOCKS_JOINED}").alias("place")).agg(
        F.collect_list(part).alias("parts"), *[F.sum(c).alias(c) for c in _COUNTS]
    )
    by_place = F.array_sort("parts", lambda a, b: (a["place"] - b["place"]).cast("int"))
    up = up.withColumn("parts", by_place).withColumns(
        {"first": F.get("parts", F.lit(0))["first"], "last": F.element_at("parts", -1)["last"]}
    )
    return written(up.withColumn("table", _joined()("parts")).select("*", "table.*").drop("table"), "joined_blocks")


def repair_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> Repair:
    """``edits`` in order (the repaired dialogue is what is not deleted) and a ``summary`` per conversation.

    Rows of a conversation stand by turn (as long, nulls first), then role and SHA-256 of the text. A row's first
    fault counts: blank, duplicate (role and text stood before) or truncated (it ends without ``.``, ``!``, ``?``).
    Edits are K(eep) at 0, R(erole) to user or assistant at 3, D(elete) at 4, which blank and duplicate rows
    must, I(nsert) of an empty turn at 3; truncated rows that stay cost 3. They leave nothing or an optional
    system turn and pairs of user and assistant, by the first letter of the role, at the least cost and, among
    equals, with the sequence of edits that sorts first.

    ``edits`` has ``conv_id``, ``seq`` and ``step`` (their order), ``edit``, ``copies`` (repeated rows that are
    deleted in a row), ``turn``, ``role`` after the edit (null if deleted) and ``text`` (empty if inserted, null
    if deleted). ``summary`` has ``conv_id``, ``gaps`` (turn numbers missing between least and greatest; null beyond
    a long), ``blank``, ``duplicate``, ``truncated``, ``illegal`` (neighbours that do not follow each other), ``cost``.

    Null roles and texts count as one space; rows without an id are one conversation, and rows without a turn
    come first. Extra columns take no part and are not returned. An empty table gives two empty tables. A
    conversation of any length is cut into blocks, and equal rows are counted before they move.
    """
    base = rows.select(
        F.col(conv_id).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("content", F.unhex(F.sha2("text", 256)))
    ordered = _ordered(base)
    levels = [_blocks(ordered)]
    while (levels[-1].agg(F.max("place")).first()[0] or 0) > 0:
        levels.append(_joined_blocks(levels[-1]))
    roots = levels[-1].withColumn("found", _endings()("cost", "order"))
    states = roots.select("conv", "place", "found.start", "found.end", "found.closing")
    for upper in reversed(levels[1:]):
        inner = _same(upper.select("conv", "place", "parts"), states, ["conv", "place"])
        states = inner.select("conv", F.inline(_between()("parts", "start", "end", "closing")))
    own = _same(levels[0].select("conv", "place", "tokens", "from_seq"), states, ["conv", "place"])
    found = own.select("from_seq", F.inline(_edits()("tokens", "start", "end", "closing")))
    found = found.select((F.col("from_seq") + F.col("at")).alias("seq"), "step", "edit", "copies", F.col("role").alias("new_role"))
    named = ordered.select("seq", *_KEY).join(found, "seq")
    kept = named.where(F.col("edit").isin("K", "R"))
    texts = base.select(*_KEY, "text").dropDuplicates(_KEY)
    stays = _same(kept, texts, _KEY).select("conv", "seq", "step", "edit", "copies", "turn", F.coalesce("new_role", "role").alias("role"), "text")
    others = named.where(F.col("edit").isin("D", "I")).select(
        "conv", "seq", "step", "edit", "copies", "turn", F.col("new_role").alias("role"),
        F.when(F.col("edit") == "I", "").alias("text"),
    )
    turns = ordered.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("held")
    )
    wide = "decimal(20,0)"
    missing = F.col("high").cast(wide) - F.col("low").cast(wide) + 1 - F.col("held")
    gaps = turns.select("conv", F.coalesce(missing, F.lit(0)).try_cast("long").alias("gaps"))
    figures = roots.select("conv", *_COUNTS, "illegal", "found.cost")
    return Repair(
        stays.unionByName(others).withColumnRenamed("conv", conv_id),
        _same(figures, gaps, ["conv"])
        .select(F.col("conv").alias(conv_id), "gaps", *_COUNTS, "illegal", "cost"),
    )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations one after the other; of each only its edits and the state of its hash are held."""
    name, audit, digest, lines = None, [], None, 0

    def out() -> pa.RecordBatch:
        values = [name, "".join(audit), digest.hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in values], ["name", "audit", "repaired_sha256"])

    for batch in batches:
        for row in batch.to_pylist():
            if digest is None or row["name"] != name:
                if digest is not None:
                    yield out()
                name, audit, digest, lines = row["name"], [], hashlib.sha256(), 0
            audit.append(row["edit"] * row["copies"])
            if row["edit"] != "D":
                digest.update(f"{chr(10) if lines else ''}{row['role']}:{row['text']}".encode())
                lines += 1
    if digest is not None:
        yield out()


def digests(edits: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """``name`` (the id as text), ``audit`` and ``repaired_sha256`` of each conversation.

    SHA-256 goes through a text from front to back, so each conversation passes through one task, as a stream.
    """
    named = edits.select(F.col(conv_id).cast("string").alias("name"), "seq", "step", "edit", "copies", "role", "text")
    by_order = named.repartition("name").sortWithinPartitions("name", "seq", "step")
    return by_order.select("name", "edit", "copies", "role", "text").mapInArrow(
        _digested, "name string, audit string, repaired_sha256 string"
    )


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns with faults chosen by a hash of id and turn; nulls of role and text become one space."""
    def space(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(space(F.col(conv_id)), F.lit(":"), space(F.col(turn)))) % 20
    marked = rows.select(conv_id, turn, space(F.col(role)).alias("r"), space(F.col(text)).alias("t"), fault.alias("f"))
    changed = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.regexp_replace("t", "[.!?]", "")).otherwise(F.col("t"))
    times = F.when(F.col("f") == 3, 2).otherwise(1)
    return marked.where("f <> 0").select(
        conv_id,
        turn,
        F.when(F.col("f") == 4, "user").otherwise(F.col("r")).alias(role),
        changed.alias(text),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    ).drop("copy")
