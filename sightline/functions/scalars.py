"""Text, time, rate and fingerprint expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(expression: Column) -> Column:
    """A costly expression as a generated column.

    Filters on what is derived from it then stay above it; otherwise the optimizer
    copies the expression into every pushed-down predicate and evaluates it each time.
    """
    return F.explode(F.array(expression))


def broken(rule: Column) -> Column:
    """True unless the rule holds: what cannot be told because a field is NULL is a breach."""
    return ~F.coalesce(rule, F.lit(False))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def place_key(text: Column) -> Column:
    """Case-insensitive lookup key, NULL unless 2-120 characters long."""
    clean = collapse_spaces(text)
    return F.when(F.length(clean).between(2, 120), F.lower(clean))


def clean_products(values: Column) -> Column:
    return F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")


def clean_polarizations(values: Column) -> Column:
    return F.filter(F.transform(values, lambda v: F.upper(F.trim(v))), lambda v: v != "")


def first_text(*candidates: Column) -> Column:
    """First candidate that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def first_number(*candidates: Column) -> Column:
    """First candidate that is neither NULL nor zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in candidates])


def parse_time(text: Column) -> Column:
    """ISO-8601 text to a timestamp; NULL when it cannot be read."""
    return F.try_to_timestamp(text)


def seconds_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later).cast("double")


def rate(numerator: Column, denominator: Column) -> Column:
    """Ratio, or NULL for an empty denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(ratio: Column) -> Column:
    """Percentage clamped to 0-100 with six decimals; NULL stays NULL."""
    return F.when(
        ratio.isNotNull(),
        F.bround(F.least(F.greatest(ratio * 100, F.lit(0.0)), F.lit(100.0)), 6),
    )


def optional_delta(a: Column, b: Column) -> Column:
    return F.bround(F.abs(a - b), 6)


def resolution_delta(a: Column, b: Column) -> Column:
    """Difference in percent of the finer value; a missing value counts as 100 %."""
    return F.when(a.isNull() | b.isNull(), F.lit(100.0)).otherwise(
        F.lit(100.0) * F.abs(a - b) / F.least(a, b)
    )


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of the compact JSON of the fields in key order, NULLs kept."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


def short_id(prefix: str, digest: Column, length: int = 20) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(digest, 1, length))
