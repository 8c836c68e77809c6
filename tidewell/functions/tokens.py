"""Text tokens to numbers, timestamps and display text."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DAY = r"(\d{4})-(\d{1,2})-(\d{1,2})"
_CLOCK = r"(\d{1,2}):(\d{1,2}):(\d{1,2}"
# year, month and day without separators, leading zeros optional
_COMPACT = r"^(\d{4})(1[0-2]|0[1-9]|[1-9])(3[01]|[12]\d|0[1-9]|[1-9])$"

# Ingest timestamp shapes, first match wins, and the ISO text they stand for.
INGEST_SHAPES = [
    (rf"^{_DAY}T{_CLOCK}(?:\.\d{{1,6}})?)$", "$1-$2-$3T$4:$5:$6"),
    (rf"^{_DAY} {_CLOCK})$", "$1-$2-$3T$4:$5:$6"),
    (rf"^{_DAY}$", "$1-$2-$3"),
    (_COMPACT, "$1-$2-$3"),
]
# Date shapes of delimited text files, day before month where both fit.
LOOSE_SHAPES = [
    (rf"^{_DAY}$", "$1-$2-$3"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"),
    (_COMPACT, "$1-$2-$3"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$2-$1"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$1-$2"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
    (rf"^{_DAY} {_CLOCK})$", "$1-$2-$3T$4:$5:$6"),
    (rf"^{_DAY}T{_CLOCK})$", "$1-$2-$3T$4:$5:$6"),
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3T$4:$5:$6"),
]


def first_match(c: Column, shapes: list[tuple[str, str]]) -> Column:
    """The first shape that fits and names a real date.

    Rewriting to ISO and casting avoids one formatter per shape, whose failures are
    exceptions: far too slow for a column of mixed shapes.
    """
    return F.coalesce(
        *[F.when(c.rlike(shape), F.regexp_replace(c, shape, iso).try_cast("timestamp")) for shape, iso in shapes]
    )


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated once.

    A filter on a result is pushed below the projection by repeating its whole expression; an
    argument that is named thirty times would then be computed thirty times per row.
    """
    return F.get(F.transform(F.array(c), use), F.lit(0))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, each computed once per row, whatever filters and columns are built on them.

    What is built on a plain column repeats its expression for each mention; above a generator only its result is seen.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse_timestamp(c: Column) -> Column:
    """Ingest timestamps; a trailing ``Z`` is accepted and means UTC."""
    clean = F.regexp_replace(F.trim(c), "Z$", "")
    return bound(clean, lambda t: first_match(t, INGEST_SHAPES))


def parse_loose(c: Column) -> Column:
    return bound(F.trim(c), lambda t: first_match(t, LOOSE_SHAPES))


def parse_any(c: Column) -> Column:
    """Cleaning accepts every known pattern, so mixed formats in one column survive."""
    clean = F.regexp_replace(F.trim(c), "Z$", "")
    return bound(clean, lambda t: first_match(t, [*INGEST_SHAPES, *LOOSE_SHAPES[1:]]))


def parse_iso_or_epoch(c: Column, unit: str = "ns") -> Column:
    """ISO text (``Z`` and offsets allowed) or an epoch number.

    Numbers below 1e10 are seconds, larger ones already count ``unit``.
    """
    per_second = {"ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}[unit]
    text = c.cast("string")
    number = text.try_cast("double")
    epoch = F.when(number < 1e10, F.timestamp_seconds(number)).otherwise(
        F.timestamp_micros((text.try_cast("decimal(38,6)") * 1_000_000 / per_second).cast("bigint"))
    )
    return F.when(number.isNotNull(), epoch).when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp")
    )


def iso_text(ts: Column) -> Column:
    """ISO 8601; the fraction appears only when there is one."""
    micros = F.unix_micros(ts) % 1_000_000
    return F.when(micros == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def render_date(ts: Column, date_format: str) -> Column:
    """Request date text: ``YYYY-MM-DD``, ``unix``, ``YYYYMMDD``, anything else ISO."""
    if date_format == "YYYY-MM-DD":
        return F.date_format(ts, "yyyy-MM-dd")
    if date_format == "unix":
        return F.unix_seconds(ts).cast("string")
    if date_format == "YYYYMMDD":
        return F.date_format(ts, "yyyyMMdd")
    return iso_text(ts)


def token_value(c: Column) -> Column:
    """A text token as ``struct(num, raw)``; null when empty.

    Without a dot only whole numbers count, so ``1e5`` stays text while ``1.5e3`` is a number.
    """
    def kind(t: Column) -> Column:
        whole = t.rlike(r"^[+-]?\d+$")
        real = t.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$")
        number = F.when(whole | real, t.try_cast("double"))
        return F.struct(t.alias("t"), whole.alias("whole"), number.alias("num"))

    def value(p: Column) -> Column:
        t = p["t"]
        raw = F.when(p["whole"], F.coalesce(t.try_cast("bigint").cast("string"), t)).otherwise(F.coalesce(p["num"].cast("string"), t))
        return F.when(F.length(t) > 0, F.struct(p["num"].alias("num"), raw.alias("raw")))

    return bound(bound(F.trim(c), kind), value)


def byte_size(c: Column) -> Column:
    """A size with its unit, two decimals from KB on; ties go to the even digit."""
    mega, kilo = 1024 * 1024, 1024
    sized = lambda unit, name: F.concat(two_decimals(c / unit), F.lit(name))
    return (
        F.when(c >= 1024 * mega, sized(1024 * mega, " GB"))
        .when(c >= mega, sized(mega, " MB"))
        .when(c >= kilo, sized(kilo, " KB"))
        .when(c.isNotNull(), F.concat(c.cast("string"), F.lit(" B")))
        .otherwise("N/A")
    )


def two_decimals(c: Column) -> Column:
    """``%.2f`` of the binary value, half-way cases decided exactly.

    The product with 100 is rounded; splitting the factor gives the rounding error, whose
    sign settles what looks like a tie. A formatter costs more than all else on the row, and
    Java's rounds the displayed digits instead of the value.
    """
    x = c.cast("double")
    cents, whole = x * 100, F.floor(x * 100).cast("double")
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * 100 - cents) + (x - high) * 100
    rounded = (
        F.when((cents - whole == 0.5) & (error > 0), whole + 1)
        .when((cents - whole == 0.5) & (error < 0), whole)
        .otherwise(F.rint(cents))
    )
    text = (rounded.cast("decimal(17,0)") * F.lit(Decimal("0.01"))).cast("decimal(19,2)").cast("string")
    return F.when(F.abs(x) < 1e13, text).when(x.isNotNull(), F.format_string("%.2f", x))
