"""Column expressions on log text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqwarden.fixed_values import MASK_LITERALS, MASK_PATTERNS, WILDCARD

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_string(*parts: ColumnOrName) -> Column:
    """Parts joined by one blank; a missing part stays as an empty text, so blanks double."""
    return F.concat_ws(" ", *[F.coalesce(as_col(p).cast("string"), F.lit("")) for p in parts])


def mask(
    message: ColumnOrName,
    patterns: Sequence[str] = MASK_PATTERNS,
    literals: Sequence[str] = MASK_LITERALS,
    unicode: bool = True,
) -> Column:
    """Replace variable parts by the wildcard, pattern by pattern.

    A plain search for the pattern's literal, where it has one, saves most of the regex
    passes. The text travels in a one-element array so that each step can name it twice.
    """
    if patterns is not MASK_PATTERNS and literals is MASK_LITERALS:
        literals = [""] * len(patterns)

    def step(pattern: str, literal: str):
        regex = f"(?U){pattern}" if unicode else pattern
        if not literal:
            return lambda t: F.regexp_replace(t, regex, WILDCARD)
        return lambda t: F.when(F.contains(t, F.lit(literal)), F.regexp_replace(t, regex, WILDCARD)).otherwise(t)

    out = F.array(as_col(message))
    for pattern, literal in zip(patterns, literals):
        out = F.transform(out, step(pattern, literal))
    return F.element_at(out, 1)


def tokens(message: ColumnOrName) -> Column:
    """Split on any whitespace, without empty tokens."""
    return F.filter(F.split(as_col(message), r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")


def contains_any(value: ColumnOrName, patterns: Sequence[str], literal: bool = False) -> Column:
    """Case-insensitive regex search for any pattern; null never matches.

    ``literal`` compares plain text instead, so that a dot is a dot.
    """
    value = as_col(value)
    hits = [
        F.contains(F.lower(value), F.lit(p.lower())) if literal else value.rlike(f"(?i){p}") for p in patterns
    ]
    found = hits[0]
    for hit in hits[1:]:
        found = found | hit
    return F.coalesce(found, F.lit(False))


def same_positions(a: ColumnOrName, b: ColumnOrName) -> Column:
    """How many positions of two token arrays are equal."""
    equal = F.zip_with(as_col(a), as_col(b), lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda acc, x: acc + x)


def similarity(template: ColumnOrName, message: ColumnOrName) -> Column:
    """Equal positions over length; 0.0 when lengths differ or both are empty."""
    template, message = as_col(template), as_col(message)
    n = F.size(template)
    comparable = (n == F.size(message)) & (n > 0)
    return F.when(comparable, same_positions(template, message) / n).otherwise(F.lit(0.0))


def generalize(template: ColumnOrName, message: ColumnOrName) -> Column:
    """Template with the wildcard wherever the message differs."""
    return F.zip_with(as_col(template), as_col(message), lambda t, m: F.when(t == m, t).otherwise(F.lit(WILDCARD)))


def percent(part: Column, whole: Column, digits: int = 0) -> Column:
    """``part / whole`` as a percentage, rounded half to even from the integers themselves."""
    scale = 100 * 10**digits
    scaled = part.cast("long") * scale
    whole = whole.cast("long")
    rest = scaled % whole
    quotient = ((scaled - rest) / whole).cast("long")
    twice = rest * 2
    up = (twice > whole) | ((twice == whole) & (F.pmod(quotient, F.lit(2)) == 1))
    units = quotient + up.cast("long")
    if not digits:
        return F.concat(units.cast("string"), F.lit("%"))
    base = 10**digits
    head = F.floor(units / base).cast("string")
    tail = F.lpad(F.pmod(units, F.lit(base)).cast("string"), digits, "0")
    return F.concat(head, F.lit("."), tail, F.lit("%"))


def pick(array: ColumnOrName, index: Column | int, default: str) -> Column:
    """Element at the 0-based index, or the default beyond the end."""
    index = index if isinstance(index, Column) else F.lit(index)
    return F.coalesce(F.try_element_at(as_col(array), index + 1), F.lit(default))


def utc_time(value: ColumnOrName, strict: bool = True) -> Column:
    """ISO-8601 text to a timestamp; strict raises on bad text, otherwise it becomes null."""
    value = as_col(value)
    return F.to_timestamp(value) if strict else F.try_to_timestamp(value)


def seconds_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    return (F.unix_micros(as_col(later)) - F.unix_micros(as_col(earlier))) / F.lit(1e6)
