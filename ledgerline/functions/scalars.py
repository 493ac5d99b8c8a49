"""Column expressions shared by the operators. All are JVM built-ins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.codes import DISPLAY_NAMES, MISSING_TOKENS

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Fixed value: file-name format of a member that is one of several parts.
SPLIT_PART_PATTERN = r"(?i)^(.*?)\s*\((\d+)\s+of\s+(\d+)\)\.txt$"
YEAR_PATTERN = r"(19[89]\d|20[0-4]\d|2050)"
MONTH_DAY_PATTERN = r"(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])"
FLOOR_VALUE = 1e-9


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient; NULL for a zero denominator."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def log_floor(c: Column | str) -> Column:
    """Natural log with zero and NULL replaced by a small floor; NULL for negatives."""
    c = _col(c)
    return F.ln(F.when(F.coalesce(c, F.lit(0.0)) == 0, F.lit(FLOOR_VALUE)).otherwise(c))


def clip(c: Column | str, low: Column, high: Column) -> Column:
    """Limit to [low, high]; NULL stays NULL, a NULL bound does not limit."""
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def add_all(*cols: str) -> Column:
    """Sum of columns; NULL when any part is NULL."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols])


def quarter_start(c: Column | str) -> Column:
    return F.date_trunc("quarter", _col(c)).cast("date")


def to_number(c: Column | str) -> Column:
    """Text to double; anything that is not a plain decimal number becomes NULL."""
    text = F.trim(_col(c))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def to_day(c: Column | str) -> Column:
    """YYYYMMDD text to date; NULL when it is not a valid day."""
    text = F.trim(_col(c).cast("string"))
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def is_digits(c: Column | str) -> Column:
    return _col(c).rlike("^[0-9]+$")


def unquote(c: Column | str) -> Column:
    """Remove surrounding blanks and double quotes."""
    return F.trim(F.regexp_replace(F.trim(_col(c)), r'^"+|"+$', ""))


def cell_value(c: Column | str) -> Column:
    """Value of one report cell: outer quotes removed, missing-value texts to NULL."""
    c = _col(c)
    text = F.when(
        c.startswith('"') & c.endswith('"'),
        F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"')),
    ).otherwise(c)
    return F.when(~F.trim(text).isin(*MISSING_TOKENS), text)


def normalise_name(c: Column | str) -> Column:
    """Lower case without any white space, for case-insensitive name matching."""
    return F.regexp_replace(F.lower(_col(c)), r"\s+", "")


def filename_date(name: Column | str) -> Column:
    """First plausible date (1980 to 2050) among the 8-digit runs of a file name, year first or month first."""
    runs = F.regexp_extract_all(_col(name), F.lit(r"(\d{8})"), 1)
    # Runs that cannot be a date are sorted out by pattern: a failed parse costs far more.
    days = F.transform(
        runs,
        lambda run: F.coalesce(
            F.when(run.rlike(f"^{YEAR_PATTERN}{MONTH_DAY_PATTERN}$"), F.try_to_date(run, "yyyyMMdd")),
            F.when(run.rlike(f"^{MONTH_DAY_PATTERN}{YEAR_PATTERN}$"), F.try_to_date(run, "MMddyyyy")),
        ),
    )
    return F.get(F.filter(days, lambda d: d.isNotNull()), F.lit(0))


def filename_quarter(name: Column | str) -> Column:
    """Reporting quarter named in a file name, such as ``Q1 2023``, else ``Unknown``."""
    day = filename_date(name)
    return F.coalesce(F.concat(F.lit("Q"), F.quarter(day), F.lit(" "), F.year(day)), F.lit("Unknown"))


def split_part(name: Column | str) -> Column:
    """Struct (base, part, total) of names like ``Base (1 of 3).txt``; NULL for other names."""
    name = _col(name)
    group = lambda i: F.regexp_extract(name, SPLIT_PART_PATTERN, i)
    return F.when(
        name.rlike(SPLIT_PART_PATTERN),
        F.struct(group(1).alias("base"), group(2).cast("int").alias("part"), group(3).cast("int").alias("total")),
    )


def display_name(c: Column | str) -> Column:
    """Report name of a variable; the variable itself when it has none."""
    names = F.create_map(*[F.lit(x) for pair in DISPLAY_NAMES.items() for x in pair])
    c = _col(c)
    return F.coalesce(F.try_element_at(names, c), c)


def random_key(c: Column | str, seed: int) -> Column:
    """Deterministic 48-bit pseudo-random number of a key, exact in a double."""
    digest = F.md5(F.concat(_col(c).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
