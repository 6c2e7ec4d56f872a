"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def week_end(day: Column) -> Column:
    """Sunday on or after `day`."""
    return F.next_day(F.date_sub(day.cast("date"), 1), "SUN")


def lenient_date(text: Column) -> Column:
    """Date of a text or timestamp; null where it does not parse."""
    return F.try_to_timestamp(text.cast("string")).cast("date")


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def column_or(df: DataFrame, name: str, default) -> Column:
    """The named column, or a constant where the table lacks it; nulls keep."""
    return F.col(name) if name in df.columns else F.lit(default)


def project_existing(df: DataFrame, required: list[str], optional: list[str] = ()) -> DataFrame:
    """Required columns and those optional ones that exist."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*required, *[c for c in optional if c in df.columns and c not in required])


def clean_key(key: Column) -> Column:
    """Join key as trimmed text."""
    return F.trim(key.cast("string"))


def instance_key(relay: str = "relay_id", store: str = "store_id", week: str = "original_wk_end_date") -> Column:
    """`relay_store_yyyy-MM-dd`, with NA for a missing date."""
    return F.concat_ws(
        "_",
        F.col(relay).cast("string"),
        F.col(store).cast("string"),
        F.coalesce(F.col(week).cast("date").cast("string"), F.lit("NA")),
    )


def half_up(value: Column, digits: int) -> Column:
    """Round a double by double arithmetic alone.

    `round` goes through the decimal text of a double, and engines differ on
    values a hair from a tie; multiply, add, floor and divide do not.
    """
    unit = float(10**digits)
    return F.floor(value.cast("double") * F.lit(unit) + F.lit(0.5)).cast("double") / F.lit(unit)


def decimal_sum(value: str | Column, scale: int = 2) -> Column:
    """Sum of the values as decimals of that scale, null over nothing.

    To make a decimal of a double goes through its text. A value below ten
    million that is a whole number of hundredths is that decimal already and
    is added up as a whole number; only the others are converted one by one.
    """
    col = F.col(value) if isinstance(value, str) else value
    number = col.cast("double")
    steps = F.rint(number * F.lit(100.0))
    plain = (F.abs(steps) < F.lit(1e9)) & (steps / F.lit(100.0) == number) if scale >= 2 else F.lit(False)
    whole = F.sum(F.when(plain, steps.cast("long"))).cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")
    rest = F.sum(F.when(plain, F.lit(None)).otherwise(col.cast(f"decimal(18,{scale})")))
    return F.coalesce(whole + rest, whole, rest)


def exact_sum(value: str | Column, scale: int = 2) -> Column:
    """Sum in decimal, so the total does not depend on the order of rows; 0 over nothing."""
    return F.coalesce(decimal_sum(value, scale).cast("double"), F.lit(0.0))


def exact_mean(value: str | Column, scale: int = 2, digits: int = 4) -> Column:
    """Mean of the non-null values from a decimal sum, rounded."""
    col = F.col(value) if isinstance(value, str) else value
    return half_up(F.sum(col.cast(f"decimal(18,{scale})")).cast("double") / F.count(col), digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(half_up(part * F.lit(100.0) / whole, digits))


def money_label(amount: Column) -> Column:
    """$x.xM from a million up, $x.xK from a thousand up, else whole dollars."""

    def scaled(divisor: int, digits: int) -> Column:
        exact = amount.cast("decimal(18,2)") / F.lit(divisor).cast("decimal(8,0)")
        return F.round(exact.cast("decimal(28,9)"), digits).cast(f"decimal(20,{digits})").cast("string")

    return (
        F.when(amount >= 1_000_000, F.concat(F.lit("$"), scaled(1_000_000, 1), F.lit("M")))
        .when(amount >= 1_000, F.concat(F.lit("$"), scaled(1_000, 1), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), scaled(1, 0)))
    )


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 0..bins-1 of `value` between `low` and `high`; the top edge is closed."""
    width = high - low
    return F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((value - low) * F.lit(float(bins)) / width).cast("int"))
    )
