"""Column expressions that read dirty text without raising under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPIRY_EPOCH = 3652  # days from 1970-01-01 to 1980-01-01


def number(text: Column) -> Column:
    """'', '-' and 'NA' are null; thousands separators go; (x) is -x; anything else that is no number is null."""
    t = F.trim(text)
    inner = F.regexp_replace(F.regexp_replace(t, r"^\((.*)\)$", "$1"), ",", "").try_cast("double")
    return F.when(t.isin("", "-", "NA"), None).when(t.rlike(r"^\(.*\)$"), -inner).otherwise(inner)


def expiry(text: Column) -> Column:
    """Seconds since 1980 as a date from 1990 to 2099; null if malformed or outside."""
    days = F.floor(F.when(text.rlike("^[0-9]+$"), text.try_cast("long")) / 86400) + EXPIRY_EPOCH
    d = F.date_add(F.lit("1970-01-01").cast("date"), F.least(days, F.lit(100000)).cast("int"))
    return F.when((d >= "1990-01-01") & (d <= "2099-12-31"), d)


def date_of(text: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")
