"""Dates written in several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.scalars import let, strip

# Written notations tried in order after serial and month.day.
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyy-M-d H:m:s", "yyyy/M/d H:m:s",
                "yyyy-M-d H:m", "yyyy/M/d H:m", "yyyy-M-d'T'H:m:s", "M/d/yyyy", "d/M/yyyy"]
LAST_SERIAL = 2958465  # 9999-12-31, the end of the spreadsheet calendar


def parse_mixed_date(c: Column, year: int = 2023) -> Column:
    """Spreadsheet serial, then ``month.day`` of a fixed year, then written dates.

    The serial test comes first, so "3.0" is serial 3 and "3.10" is 10 March.
    Anything else is NULL.
    """
    text = F.replace(strip(c), F.lit("日"), F.lit(""))
    return let(text, lambda s: _parsed(s, year))


def _parsed(s: Column, year: int) -> Column:
    serial = F.regexp_extract(s, r"^(\d+)(\.0+)?$", 1).try_cast("long")
    by_serial = F.when(serial <= LAST_SERIAL, F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int")))
    by_month_day = F.try_to_timestamp(
        F.concat(F.lit(f"{year}-"), F.replace(s, F.lit("."), F.lit("-"))), F.lit("yyyy-M-d")).cast("date")
    written = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("date") for f in DATE_FORMATS])
    return (F.when(s.rlike(r"^\d+(\.0+)?$"), by_serial)
            .when(s.rlike(r"^\d{1,2}\.\d{1,2}$"), by_month_day)
            .otherwise(written))


def date_parts(c: Column) -> dict[str, Column]:
    """Month, weekday (Monday = 0) and ISO text of a date."""
    return {"month": F.month(c), "weekday": F.weekday(c), "iso": F.date_format(c, "yyyy-MM-dd")}
