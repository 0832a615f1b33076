"""Scalar column expressions: coercion, normalisation, scoring, formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions import vocab

# Shapes of dates, each with the text that puts it in the order year-month-day and
# what follows.  Strings made only of digits are never dates.
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_MONTH = rf"({MONTHS})[a-z]*[.]?"
DATE_SHAPES = (
    (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?!\d)(.*)$", "$1-$2-$3$4"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})(?!\d)(.*)$", "$3-$2-$1$4"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?!\d)(.*)$", "$3-$1-$2$4"),
    (rf"^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? )?(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}})(?!\d)(.*)$", "$3-$2-$1$4"),
    (rf"^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? )?{_MONTH} (\d{{1,2}}),? (\d{{4}})(?!\d)(.*)$", "$3-$1-$2$4"),
    (rf"^{_MONTH},? (\d{{4}})()$", "$2-$1-1$3"),
)
# Hour, minutes, seconds, half of the day, offset; each optional from the seconds on.
TIME_SHAPE = r"^(?:,?[ t](\d{1,2}):(\d{2})(?::(\d{2}(?:[.]\d{1,9})?))?(?: ?([ap])[.]?m[.]?)?(?: ?(z|utc|gmt|[+-]\d{2}(?::?\d{2})?))?)?$"
# Every character Python counts as white space, for engines whose \s is ASCII.
ANY_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def missing_token_to_null(col: Column, tokens: Sequence[str] = vocab.MISSING_TOKENS) -> Column:
    """NULL where the trimmed, lower-cased text is one of the missing tokens."""
    stripped = F.lower(F.regexp_replace(col, rf"^{ANY_SPACE}|{ANY_SPACE}$", ""))
    return F.when(~stripped.isin(list(tokens)), col)


def normalize_missing(df: DataFrame, tokens: Sequence[str] = vocab.MISSING_TOKENS) -> DataFrame:
    """Missing tokens in string columns and NaN in float columns become NULL."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            out.append(missing_token_to_null(c, tokens).alias(field.name))
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.when(~F.isnan(c), c).alias(field.name))
        else:
            out.append(c)
    return df.select(*out)


def to_number(col: Column) -> Column:
    """Double, or NULL where the value is not a finite number."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def to_timestamp_lenient(col: Column) -> Column:
    """Timestamp of a text in one of the known shapes, else NULL.

    The shape picks one rewriting to the standard form, which is parsed once:
    month names, 12-hour clocks and offsets without a colon or minutes included.
    """
    text = F.lower(F.trim(col))
    start = r"^(\d{4}-(?:\d{1,2}|[a-z]{3})-\d{1,2})"
    ordered = F.coalesce(*[F.when(text.rlike(shape), F.regexp_replace(text, shape, order)) for shape, order in DATE_SHAPES])
    rest = F.regexp_replace(ordered, start, "")
    day = F.regexp_extract(ordered, start, 1)
    name = F.regexp_extract(day, "([a-z]{3})", 1)
    number = ((F.position(name, F.lit(MONTHS)) + 3) / 4).cast("int").cast("string")
    date = F.when(name != "", F.replace(day, name, number)).otherwise(day)

    def part(group: int) -> Column:
        return F.regexp_extract(rest, TIME_SHAPE, group)

    hour, half = part(1).try_cast("int"), part(4)
    whole = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    zone = F.when(part(5).isin("", "z", "utc", "gmt"), F.when(part(5) != "", "Z").otherwise("")).otherwise(
        F.concat(F.substring(part(5), 1, 3), F.lit(":"), F.rpad(F.regexp_replace(F.substring(part(5), 4, 3), ":", ""), 2, "0")))
    seconds = F.when(part(3) != "", part(3)).otherwise("00")
    timed = F.when(part(1) != "", F.concat(F.lit(" "), whole.cast("string"), F.lit(":"), part(2), F.lit(":"), seconds, zone)).otherwise("")
    return F.when(rest.rlike(TIME_SHAPE), F.concat(date, timed).try_cast("timestamp"))


def to_boolean(col: Column) -> Column:
    return F.lower(F.trim(col.cast("string"))).isin(vocab.TRUE_TOKENS)


def is_boolean_word(col: Column) -> Column:
    return F.lower(F.trim(col.cast("string"))).isin(vocab.TRUE_TOKENS + vocab.FALSE_TOKENS)


def safe_round(col: Column, places: int = 6) -> Column:
    """Rounded value, halves to even; NaN and infinities become NULL."""
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), F.bround(col, places))


def collapse_spaces(col: Column) -> Column:
    """White space runs to one blank, none at the ends; NULL counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), ANY_SPACE, " "))


def rising_score(value: Column, poor: float, target: float) -> Column:
    """0 at or below ``poor``, 100 at or above ``target``, linear between."""
    inside = F.round((value - poor) / (target - poor) * 100.0, 2)
    return F.when(value <= poor, 0.0).when(value >= target, 100.0).otherwise(inside)


def falling_score(value: Column, target: float, poor: float) -> Column:
    """100 at or below ``target``, 0 at or above ``poor``, linear between."""
    inside = F.round((F.lit(poor) - value) / (poor - target) * 100.0, 2)
    return F.when(value <= target, 100.0).when(value >= poor, 0.0).otherwise(inside)


def curve_score(value: Column, zero_at: float, full_at: float) -> Column:
    if zero_at < full_at:
        return rising_score(value, zero_at, full_at)
    return falling_score(value, full_at, zero_at)


def stepwise(value: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first threshold the value reaches."""
    out = None
    for threshold, label in steps:
        out = F.when(value >= threshold, label) if out is None else out.when(value >= threshold, label)
    return out.otherwise(otherwise)


def grade(score: Column) -> Column:
    return stepwise(score, vocab.GRADES, "F")


def _shown(pattern: str, value: Column, places: int) -> Column:
    # Halves go to the even digit first: formatting alone would round them up.
    near = F.bround(value, places)
    return F.format_string(pattern, F.when((near == 0) & (value < 0), F.lit(-0.0)).otherwise(near))  # -0.004 keeps its sign


def signed(value: Column, places: int) -> Column:
    """Always with a sign, thousands not separated."""
    return _shown(f"%+.{places}f", value, places)


def fixed(value: Column, places: int) -> Column:
    return _shown(f"%.{places}f", value, places)


def grouped(value: Column, places: int) -> Column:
    """Thousands separated by commas."""
    return _shown(f"%,.{places}f", value, places)


def format_value(value: Column, unit: Column) -> Column:
    text = (
        F.when(unit == "percent", F.concat(fixed(value, 2), F.lit("%")))
        .when(unit == "ratio", F.concat(fixed(value, 2), F.lit("x")))
        .when(unit == "count", grouped(value, 0))
        .when(unit == "days", F.concat(grouped(value, 0), F.lit(" days")))
        .otherwise(grouped(value, 2))
    )
    known = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(known, text).otherwise("—")


def unit_suffix(unit: Column) -> Column:
    return F.when(unit == "percent", " pp").when(unit == "ratio", "x").otherwise("")


def period_label(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def coverage_level(coverage: Column) -> Column:
    return (
        F.when(coverage >= 0.75, "high").when(coverage >= 0.4, "medium")
        .when(coverage > 0, "low").otherwise("none")
    )


def coverage_badge(coverage: Column) -> Column:
    value = F.coalesce(coverage, F.lit(0.0))
    return F.when(value >= 0.75, "High").when(value >= 0.5, "Medium").otherwise("Low")


def preserves_numbers(source: Column, rewrite: Column) -> Column:
    """True when every number of the source text occurs in the rewrite."""
    def numbers(col: Column) -> Column:
        return F.regexp_extract_all(col, F.lit(f"({vocab.NUMBER_PATTERN})"), F.lit(1))

    return F.size(F.array_except(numbers(source), numbers(rewrite))) == 0
