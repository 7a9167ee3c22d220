"""Calendar columns derived from a transaction date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_key(date_col: Column | str) -> Column:
    """``yyyy-MM`` text of a date."""
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.date_format(c, "yyyy-MM")


def year_int(date_col: Column | str) -> Column:
    """Calendar year as int."""
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.year(c).cast("int")


def parse_date_lenient(text_col: Column | str) -> Column:
    """Date text (``YYYY-MM-DD``) → date; unparsable text → null, so the
    caller can count violations and decide whether to fail."""
    c = F.trim(F.col(text_col) if isinstance(text_col, str) else text_col)
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), c.try_cast("date"))
