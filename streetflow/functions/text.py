"""Text forms of points and dirty numeric text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from streetflow.schema import RATIO_SENTINELS


def point_wkt(p: Column) -> Column:
    return F.format_string("POINT(%s %s)", p["x"], p["y"])


def parse_point_wkt(text: Column) -> Column:
    """struct(x, y) of ``POINT(x y)``; NULL when the text has another form."""
    body = F.regexp_extract(text, r"\((.*)\)", 1)
    parts = F.split(F.trim(body), r"\s+")
    x, y = (F.get(parts, F.lit(i)).try_cast("double") for i in (0, 1))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def number(text: Column) -> Column:
    """try_cast to double with NaN as NULL."""
    v = text.try_cast("double")
    return F.when(~F.isnan(v), v)


def safe_ratio(text: Column) -> Column:
    """Ratio text to double; the router's failure markers become NULL."""
    return F.when(~text.isin(*RATIO_SENTINELS), number(text))
