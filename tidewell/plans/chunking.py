"""Order-dependent columns without putting a whole series into one task.

A window over ``PARTITION BY series`` sends every row of a series to one task, and a
window without ``PARTITION BY`` sends the whole table to one. Both break as soon as one
series holds a large share of the rows. Here the order key is cut into equal-depth chunks
and the window runs per ``(series, chunk)``. What a chunk needs from its neighbours (last
known value, rows before it, running sums) is a one-row summary per chunk; the summaries
are scanned in chunk order and re-enter the detail rows as *edge rows* at the head or tail
of each chunk, so the detail is shuffled once and never joined.

The result equals the plain window. Small inputs take the plain window.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from math import inf, isfinite, nextafter

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_CHUNK = 4_000_000
MAX_CHUNKS = 4096
#: chunk numbers kept for the second key within one chunk of the first
INNER_CHUNKS = 1 << 32
#: text order keys: sampled texts per chunk, and how many of their characters a cut point keeps
SAMPLE_PER_CHUNK = 20
CUT_LENGTH = 200

CHUNK = "__chunk"
EDGE = "__edge"
_KEY = "__chunk_key"

_NUMBERS = (T.TimestampType, T.TimestampNTZType, T.DateType, T.NumericType)

FIRST_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def numeric_key(df: DataFrame, column: str) -> Column:
    """An order-preserving DOUBLE for a timestamp, date or numeric column."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(column)).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("double")
    raise TypeError(f"cannot cut chunks along {column!r} of type {kind.simpleString()}")


def text_key(df: DataFrame, column: str) -> Column | None:
    """An order-preserving text for a text, binary or boolean column, else None."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if isinstance(kind, T.StringType) and getattr(kind, "collation", "UTF8_BINARY") != "UTF8_BINARY":
        return None
    return F.col(column).cast("string") if isinstance(kind, (T.StringType, T.BooleanType)) else None


class Cuts(list):
    """Cut points of the first order key. ``inner`` has, by the chunk of a key that fills more than one, the cut
    points of the second order key in it."""

    def __init__(self, cuts: Iterable = (), inner: dict[int, list[float]] | None = None) -> None:
        super().__init__(cuts)
        self.inner = inner or {}

    def __bool__(self) -> bool:
        return len(self) > 0 or bool(self.inner)


def chunk_bounds(df: DataFrame, order: str | Sequence[str], rows_per_chunk: int | None = None) -> Cuts:
    """Inner cut points of equal-depth chunks along ``order``; empty when one chunk is enough.

    The number of chunks follows the rows: ``MAX_CHUNKS`` numbers come from one aggregation, and beyond it each of
    those chunks is cut further by a second one, grouped by chunk. Texts are cut in their own order, as the
    window reads them, at beginnings of ``CUT_LENGTH`` characters taken from a sample, at most ``MAX_CHUNKS``. A
    column that is none of these (an array, say) stays one chunk, so that its result does not depend on the
    number of rows. With several keys, rows that share a first key (or have none) and are more than a chunk are
    cut along the second one if that is a time or a number; a name alone never separates equal keys.
    """
    keys = [order] if isinstance(order, str) else list(order)
    column = keys[0]
    text = text_key(df, column)
    if text is None and not isinstance(df.schema[column].dataType, _NUMBERS):
        return Cuts()
    rows_per_chunk = rows_per_chunk or ROWS_PER_CHUNK
    rows, present = df.agg(F.count("*"), F.count(column)).first()
    if rows <= rows_per_chunk:
        return Cuts()
    n = -(-rows // rows_per_chunk)
    outer = min(MAX_CHUNKS, n)
    if text is not None:
        starts = df.select(F.substring(text, 1, CUT_LENGTH).alias("s")).where("s IS NOT NULL")
        share = min(1.0, SAMPLE_PER_CHUNK * outer / rows)
        sample = sorted(r["s"] for r in starts.sample(fraction=share, seed=7).limit(2 * SAMPLE_PER_CHUNK * outer).collect())
        times = Counter(sample[len(sample) * i // outer] for i in range(1, outer)) if sample else Counter()
    else:
        times = Counter(_quantiles(df.select(numeric_key(df, column).alias(_KEY)), _KEY, outer))
        if n > outer:
            finer = -(-n // outer)
            times = Counter({v: k * finer for v, k in times.items()})
            for cuts in _quantiles_within(with_chunk(df, column, sorted(times)), numeric_key(df, column), finer):
                times.update(cuts)
    if present < rows:
        times[None] = (rows - present) // rows_per_chunk
    heavy = {v: k + 1 for v, k in times.items() if k > 1 or (v is None and k)}
    times.pop(None, None)
    if not heavy or len(keys) == 1 or not isinstance(df.schema[keys[1]].dataType, _NUMBERS):
        return Cuts(sorted(times))
    return _with_inner(df, keys, sorted(times), heavy)


def _with_inner(df: DataFrame, keys: Sequence[str], cuts: list, heavy: dict) -> Cuts:
    """``cuts`` with the cut points of the second key for the ``heavy`` first keys (a number of parts for each)."""
    text, kind = text_key(df, keys[0]), df.schema[keys[0]].dataType
    first = numeric_key(df, keys[0]) if text is None else text

    def exact(v) -> bool:
        """Whether rows that agree in ``v`` agree in the key itself."""
        if v is None:
            return True
        if isinstance(v, str):
            return len(v) < CUT_LENGTH
        if isinstance(kind, T.DecimalType) and kind.precision > 15:
            return False
        return isfinite(v) and (abs(v) < 1 << 53 or isinstance(kind, (T.DoubleType, T.FloatType)))

    parts = {v: k for v, k in heavy.items() if exact(v)}
    alone = sorted(set(cuts) | {f"{v}\0" if isinstance(v, str) else nextafter(v, inf) for v in parts if v is not None})
    rows = df.select(first.alias("v"), numeric_key(df, keys[1]).alias("k"))
    wanted = F.col("v").isin([v for v in parts if v is not None])
    rows = rows.where((wanted | F.col("v").isNull()) if None in parts else wanted)
    most = max(parts.values(), default=0)
    if not most:
        return Cuts(alone)
    probs = [i / most for i in range(1, most)]
    found = rows.groupBy("v").agg(F.percentile_approx("k", probs, 20 * max(most, 100)).alias("q")).collect()  # one row per heavy key
    inner = {}
    for v, q in found:
        edges = sorted({q[len(q) * i // parts[v]] for i in range(1, parts[v])}) if q else []
        inner[-1 if v is None else bisect_right(alone, v)] = [e for e in edges if isfinite(e)]
    return Cuts(alone, {at: edges for at, edges in inner.items() if edges})


def _quantiles(df: DataFrame, column: str, n: int) -> list[float]:
    """The finite n-quantiles, repeated ones as often as they occur."""
    probs = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(column, probs, 20 * max(n, 100)).alias("q")).first()
    return sorted(v for v in row["q"] or [] if isfinite(v))


def _quantiles_within(chunked: DataFrame, key: Column, n: int) -> list[list[float]]:
    """The finite n-quantiles of each chunk: ``n`` numbers per chunk, as many as there will be chunks."""
    probs = [i / n for i in range(1, n)]
    rows = chunked.groupBy(CHUNK).agg(F.percentile_approx(key, probs, 20 * max(n, 100)).alias("q")).collect()
    return [[v for v in r["q"] or [] if isfinite(v)] for r in rows]


def quantile_edges(df: DataFrame, column: str, n: int) -> list[float]:
    return sorted(set(_quantiles(df, column, n)))


def isolate_repeats(edges: Sequence[float]) -> list[float]:
    """Add a cut right after every edge, so that a heavy single value gets its own cell."""
    return sorted({e for v in edges for e in (v, nextafter(v, inf))})


def _cuts_up_to(key: Column, bounds: Sequence[str]) -> Column:
    """How many cut points are not above ``key``: looked up among every 64th of them, then among 64."""
    cuts = F.array(*[F.lit(b) for b in bounds])
    heads = F.array(*[F.lit(b) for b in bounds[::64]])
    full = F.greatest(F.size(F.filter(heads, lambda c: c <= key)) - 1, F.lit(0)) * 64
    return full + F.size(F.filter(F.slice(cuts, full + 1, 64), lambda c: c <= key))


def with_chunk(
    df: DataFrame, order: str | Sequence[str], bounds: Sequence[float] | Sequence[str], name: str = CHUNK
) -> DataFrame:
    """Tag rows with their chunk along ``order``. Null keys form the first chunk, as nulls sort first."""
    if not bounds:
        return df.withColumn(name, F.lit(0))
    keys = [order] if isinstance(order, str) else list(order)
    text = text_key(df, keys[0])
    if not len(bounds):  # only missing keys are cut
        cut = df.withColumn(name, F.when(F.col(keys[0]).isNull(), F.lit(-1)).otherwise(F.lit(0)))
    elif text is not None:
        cut = df.withColumn(name, F.when(text.isNull(), F.lit(-1)).otherwise(_cuts_up_to(text, bounds)))
    else:
        keyed = df.withColumn(_KEY, numeric_key(df, keys[0]))
        cut = Bucketizer(
            splits=[-inf, *bounds, inf], inputCol=_KEY, outputCol=name, handleInvalid="keep"
        ).transform(keyed)
        index = F.when(F.col(_KEY).isNull(), F.lit(-1)).otherwise(F.col(name).cast("int"))
        cut = cut.withColumn(name, index).drop(_KEY)
    inner = getattr(bounds, "inner", None)
    if not inner:
        return cut
    within = F.arrow_udf(_passed(inner), "bigint")(F.col(name), numeric_key(df, keys[1]))
    return cut.withColumn(name, F.col(name) * INNER_CHUNKS + within)


def _passed(inner: dict[int, list[float]]) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """How many of the cut points of its chunk are not above each key, all rows halving their own range at a time."""
    chunks = np.array(sorted(inner), np.int64)
    cuts = np.concatenate([np.array(inner[c], float) for c in chunks.tolist()])
    ends = np.cumsum([len(inner[c]) for c in chunks.tolist()])
    starts = np.append(0, ends[:-1])

    def run(chunk: pa.Array, key: pa.Array) -> pa.Array:
        own = chunk.to_numpy(zero_copy_only=False).astype(np.int64)
        keys = key.fill_null(-inf).to_numpy(zero_copy_only=False)
        keys = np.where(np.isnan(keys), inf, keys)  # NaN sorts last
        at = np.minimum(np.searchsorted(chunks, own), len(chunks) - 1)
        first = starts[at]
        low, high = first.copy(), np.where(chunks[at] == own, ends[at], first)
        while (searched := np.flatnonzero(low < high)).size:
            middle = (low[searched] + high[searched]) // 2
            passed = cuts[middle] <= keys[searched]
            low[searched] = np.where(passed, middle + 1, low[searched])
            high[searched] = np.where(passed, high[searched], middle)
        return pa.array(low - first)

    return run


def along(by: Sequence[str], order: Sequence[str], backward: bool = False) -> WindowSpec:
    """A window that is read from its start.

    Looking ahead is a backward scan over the reversed order: a frame that ends at UNBOUNDED
    FOLLOWING is evaluated anew for every row, which is quadratic.
    """
    return Window.partitionBy(*by).orderBy(*[F.col(o).desc() if backward else F.col(o) for o in order])


def chunk_window(by: Sequence[str], order: Sequence[str], backward: bool = False) -> WindowSpec:
    return along([*by, CHUNK], [EDGE, *order], backward)


def _present(value: str, order: Sequence[str]) -> Column:
    return F.when(F.col(value).isNotNull(), F.struct(*[F.col(o) for o in order]))


def fill_ordered(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    by: Sequence[str] = (),
    backward: bool = False,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Replace nulls by the previous (or next) non-null value in ``order`` within ``by``."""
    if bounds is None:
        bounds = chunk_bounds(df, order)
    names = df.columns
    by = list(by)
    targets = [c for c in columns if c not in by]

    if not bounds and by:
        w = along(by, order, backward).rowsBetween(*FIRST_TO_HERE)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in targets})

    cut = with_chunk(df, order, bounds)
    nearest = F.min_by if backward else F.max_by
    # order columns may be filled themselves, so summaries travel under their own names
    carried = {f"__carry{i}": c for i, c in enumerate(targets)}
    summary = cut.groupBy(*by, CHUNK).agg(
        *[nearest(c, _present(c, order)).alias(k) for k, c in carried.items()]
    )
    across = along(by, [CHUNK], backward).rowsBetween(*BEFORE)
    edges = summary.select(
        *by,
        CHUNK,
        F.lit(1 if backward else -1).alias(EDGE),
        *[F.last(k, ignorenulls=True).over(across).alias(k) for k in carried],
    )
    rows = cut.withColumn(EDGE, F.lit(0)).withColumns({k: F.col(c) for k, c in carried.items()})
    both = rows.unionByName(edges, allowMissingColumns=True)
    w = chunk_window(by, order, backward).rowsBetween(*FIRST_TO_HERE)
    filled = both.withColumns({c: F.last(k, ignorenulls=True).over(w) for k, c in carried.items()})
    return filled.where(F.col(EDGE) == 0).select(*names)


def running_totals(
    df: DataFrame,
    totals: dict[str, Column],
    order: Sequence[str],
    by: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Inclusive running sums of ``totals`` in ``order`` within ``by``."""
    if bounds is None:
        bounds = chunk_bounds(df, order)
    by = list(by)
    rows = df.withColumns(totals)
    if not bounds and by:
        w = along(by, order).rowsBetween(*FIRST_TO_HERE)
        return rows.withColumns({n: F.sum(n).over(w) for n in totals})

    cut = with_chunk(rows, order, bounds)
    summary = cut.groupBy(*by, CHUNK).agg(*[F.sum(n).alias(n) for n in totals])
    across = along(by, [CHUNK]).rowsBetween(*BEFORE)
    edges = summary.select(
        *by, CHUNK, F.lit(-1).alias(EDGE), *[F.sum(n).over(across).alias(n) for n in totals]
    )
    both = cut.withColumn(EDGE, F.lit(0)).unionByName(edges, allowMissingColumns=True)
    w = chunk_window(by, order).rowsBetween(*FIRST_TO_HERE)
    summed = both.withColumns({n: F.sum(n).over(w) for n in totals})
    return summed.where(F.col(EDGE) == 0).drop(EDGE, CHUNK)


def row_positions(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "position",
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """1-based position of each row in ``order`` within ``by``."""
    return running_totals(df, {name: F.lit(1).cast("long")}, order, by, bounds)
