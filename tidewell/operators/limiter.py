"""Rate limits over stored events: which would have been allowed.

Both limiters depend on what happened before, per key. A key may hold a large share of all
events, so no key is ever replayed in one task; its timeline is cut into chunks, every
chunk is summarised, and the summaries are combined in order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.plans import chunking
from tidewell.session import written

_US = "__us"


def _walk(times: np.ndarray, window: int, start: int) -> np.ndarray:
    """Window starts in one chunk of sorted times, the first being ``times[start]``."""
    starts = []
    i = start
    while i < len(times):
        starts.append(times[i])
        i = int(np.searchsorted(times, times[i] + window, side="left"))
    return np.array(starts, dtype=np.int64)


def _exits(times: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each possible entry time of a chunk, the last window start it leads to.

    A window that is open on entry ends less than ``window`` after the chunk's first event, so
    only events up to the first one beyond that can start the first window of the chunk. Walks
    that meet stay together, which leaves few distinct results; equal neighbours are merged.
    """
    following = np.searchsorted(times, times + window, side="left")
    last = times.copy()
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            last[i] = last[following[i]]
    upto = int(np.searchsorted(times, times[0] + window, side="left")) + 1
    entries, results = times[:upto], last[:upto]
    return _merged(entries, results)


def _rows(like: pa.Table, names: Sequence[str], ids: Sequence, **columns: np.ndarray) -> pa.Table:
    """A table of the group's keys, repeated, next to integer ``columns``."""
    n = len(next(iter(columns.values())))
    same = [pa.array([i.as_py()] * n, like.schema.field(k).type) for k, i in zip(names, ids)]
    return pa.table([*same, *[pa.array(c, pa.int64()) for c in columns.values()]], [*names, *columns])


def _lead(entries: np.ndarray, results: np.ndarray, opened: np.ndarray, width: int) -> np.ndarray:
    """The open window after a stretch of time, for each window open before it."""
    at = np.searchsorted(entries, opened + width, side="left")
    inside = at < len(entries)
    after = opened.copy()
    after[inside] = results[at[inside]]
    return after


def _merged(entries: np.ndarray, results: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.append(results[1:] != results[:-1], True)
    return entries[ends], results[ends]


def _side(pair: pa.Table, right: bool) -> tuple[np.ndarray, np.ndarray]:
    half = pair.filter(pc.equal(pc.bit_wise_and(pair[chunking.CHUNK], 1), int(right)))
    half = half.filter(pc.is_valid(half["entry"])).sort_by("entry")
    return half["entry"].to_numpy(), half["result"].to_numpy()


def _open_on_entry(summaries: DataFrame, key: str, width: int) -> DataFrame:
    """The window open when each chunk begins: a parallel prefix over the chunk summaries.

    Going up, summaries of neighbouring chunks are joined pairwise; going down, what enters a
    pair is handed to its halves. A task holds two summaries at most, however busy a key is,
    and there are as many rounds as doublings of the number of chunks.
    """
    key_type = summaries.schema[key].dataType.simpleString()
    shape = f"`{key}` {key_type}, `{chunking.CHUNK}` int"
    parent = F.shiftright(chunking.CHUNK, 1).alias("__parent")
    names = [key, chunking.CHUNK]

    def join(ids: tuple, pair: pa.Table) -> pa.Table:
        (le, lr), (re, rr) = _side(pair, False), _side(pair, True)
        entries = np.concatenate([le, re])
        results = np.concatenate([_lead(re, rr, lr, width) if len(re) else lr, rr])
        return _rows(pair, names, ids, **dict(zip(("entry", "result"), _merged(entries, results))))

    def hand_down(ids: tuple, pair: pa.Table) -> pa.Table:
        opened = pc.max(pair["window_us"]).as_py()
        left = _side(pair, False)
        known = [] if opened is None else [(0, opened)]
        if not len(left[0]):
            known += [] if opened is None else [(1, opened)]
        elif opened is None:
            known.append((1, int(left[1][0])))
        else:
            known.append((1, int(_lead(*left, np.array([opened]), width)[0])))
        both = [(2 * ids[1].as_py() + side, at) for side, at in known]
        columns = [
            pa.array([ids[0].as_py()] * len(both), pair.schema.field(key).type),
            pa.array([c for c, _ in both], pa.int32()),
            pa.array([at for _, at in both], pa.int64()),
        ]
        return pa.table(columns, [*names, "window_us"])

    levels = [summaries]
    last = summaries.agg(F.max(chunking.CHUNK)).first()[0] or 0
    for _ in range(last.bit_length()):
        paired = levels[-1].withColumn("__parent", parent).groupBy(key, "__parent")
        levels.append(written(paired.applyInArrow(join, f"{shape}, entry long, result long"), "level"))
    opened = None
    for level in reversed(levels[:-1]):
        halves = level.withColumn("window_us", F.lit(None).cast("long"))
        if opened is not None:
            halves = halves.unionByName(opened.withColumn("__parent", F.col(chunking.CHUNK)), allowMissingColumns=True)
        halves = halves.withColumn("__parent", F.coalesce("__parent", parent) if opened is not None else parent)
        opened = halves.groupBy(key, "__parent").applyInArrow(hand_down, f"{shape}, window_us long")
        opened = written(opened, "opened")
    return opened


def _light_and_heavy(
    events: DataFrame, key: str, limited: Callable[[DataFrame, Sequence[float]], DataFrame], bounds: Sequence[float]
) -> DataFrame:
    """Only the timelines of keys with more events than a chunk holds are cut; each other key is a group of its own."""
    sizes = events.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__rows"))
    heavy = written(sizes.where(F.col("__rows") > chunking.ROWS_PER_CHUNK).select("__key"), "heavy_keys")
    if heavy.isEmpty():
        return limited(events, [])
    same = F.col(key).eqNullSafe(F.col("__key"))
    light = limited(events.join(heavy, same, "left_anti"), [])
    return light.unionByName(limited(events.join(heavy, same, "left_semi"), bounds))


def fixed_window(
    events: DataFrame,
    key: str,
    ts: str,
    limit: int,
    window: int,
    order: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """A window opens at a key's first event and lasts ``window`` seconds; the next opens at
    the first event after it. The first ``limit`` events of each window are allowed.

    Adds ``window_start``, ``allowed``, ``remaining`` and ``reset_in`` (seconds).
    """
    width = window * 1_000_000
    names = events.columns
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull())
    if bounds is None:
        bounds = chunking.chunk_bounds(timed, ts)
        if bounds:
            return _light_and_heavy(timed, key, lambda part, cuts: fixed_window(part, key, ts, limit, window, order, cuts), bounds)
    chunked = chunking.with_chunk(timed, ts, bounds).withColumn(_US, F.unix_micros(ts))
    keys = [key, chunking.CHUNK]
    moments = chunked.select(*keys, _US)
    key_type = events.schema[key].dataType.simpleString()
    shape = f"`{key}` {key_type}, `{chunking.CHUNK}` int"

    def summarise(ids: tuple, chunk: pa.Table) -> pa.Table:
        entries, results = _exits(np.unique(chunk[_US].to_numpy()), width)
        return _rows(chunk, keys, ids, entry=entries, result=results)

    def starts(ids: tuple, chunk: pa.Table) -> pa.Table:
        """Window starts of one chunk, given the window that is open on entry, if any."""
        times = np.unique(chunk[_US].drop_null().to_numpy())
        opened = pc.max(chunk["window_us"]).as_py()
        first = 0 if opened is None else int(np.searchsorted(times, opened + width, side="left"))
        return _rows(chunk, keys, ids, window_us=_walk(times, width, first))

    start_shape = f"{shape}, window_us long"
    if bounds:
        summaries = written(
            moments.groupBy(*keys).applyInArrow(summarise, f"{shape}, entry long, result long"), "summaries"
        )
        opened = _open_on_entry(summaries, key, width)
        entered = moments.unionByName(opened, allowMissingColumns=True)
        marks = entered.groupBy(*keys).applyInArrow(starts, start_shape).unionByName(opened)
    else:
        entered = moments.withColumn("window_us", F.lit(None).cast("long"))
        marks = entered.groupBy(*keys).applyInArrow(starts, start_shape)

    # starts re-enter the timeline as rows; each event takes the latest start up to it
    marks = marks.withColumn(_US, F.col("window_us")).withColumn(chunking.EDGE, F.lit(-1))
    both = chunked.withColumn(chunking.EDGE, F.lit(0)).unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy(_US, chunking.EDGE).rowsBetween(*chunking.FIRST_TO_HERE)
    placed = (
        both.withColumn("window_us", F.last("window_us", ignorenulls=True).over(upto))
        .where(F.col(chunking.EDGE) == 0)
        .drop(chunking.EDGE, chunking.CHUNK)
    )
    counted = chunking.row_positions(placed, [ts, *order], [key, "window_us"], "__n", bounds)
    left = F.lit(width) - (F.col(_US) - F.col("window_us"))
    return counted.select(
        *names,
        F.timestamp_micros("window_us").alias("window_start"),
        (F.col("__n") <= limit).alias("allowed"),
        F.greatest(F.lit(limit) - F.col("__n"), F.lit(0)).cast("long").alias("remaining"),
        (left / 1e6).alias("reset_in"),
    )


def quiet_gap(
    events: DataFrame,
    key: str,
    ts: str,
    limit: int,
    window: int,
    order: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Every event renews the expiry, so the count restarts only after a quiet gap of
    ``window`` seconds. Adds ``session_start``, ``allowed`` and ``remaining``.
    """
    names = events.columns
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull())
    if bounds is None:
        bounds = chunking.chunk_bounds(timed, ts)
    by, along = [key], [ts, *order]
    placed = chunking.row_positions(timed, along, by, "__at", bounds)
    gapped = _with_previous(placed, key, ts, along, bounds)
    opens = F.col("__previous").isNull() | (
        F.unix_micros(ts) - F.unix_micros("__previous") >= window * 1_000_000
    )
    marked = gapped.withColumn("__open", F.when(opens, F.struct(F.col("__at").alias("at"), F.col(ts).alias("ts"))))
    filled = chunking.fill_ordered(marked, ["__open"], along, by, False, bounds)
    count = F.col("__at") - F.col("__open.at") + 1
    return filled.select(
        *names,
        F.col("__open.ts").alias("session_start"),
        (count <= limit).alias("allowed"),
        F.greatest(F.lit(limit) - count, F.lit(0)).cast("long").alias("remaining"),
    )


def _with_previous(df: DataFrame, key: str, ts: str, along: Sequence[str], bounds) -> DataFrame:
    """The preceding event's time; for the first event of a chunk, the last one before it."""
    cut = chunking.with_chunk(df, ts, bounds)
    inside = Window.partitionBy(key, chunking.CHUNK).orderBy(*along)
    if not bounds:
        return cut.withColumn("__previous", F.lag(ts).over(inside)).drop(chunking.CHUNK)
    ends = cut.groupBy(key, chunking.CHUNK).agg(F.max(ts).alias("__end"))
    across = Window.partitionBy(key).orderBy(chunking.CHUNK)
    edges = ends.select(
        key, chunking.CHUNK, F.lit(-1).alias(chunking.EDGE), F.lag("__end").over(across).alias("__end")
    )
    rows = cut.withColumn(chunking.EDGE, F.lit(0)).withColumn("__end", F.col(ts))
    both = rows.unionByName(edges, allowMissingColumns=True)
    w = chunking.chunk_window([key], along)
    lagged = both.withColumn("__previous", F.lag("__end").over(w))
    return lagged.where(F.col(chunking.EDGE) == 0).drop(chunking.EDGE, chunking.CHUNK, "__end")
