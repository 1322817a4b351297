"""Coordinates of atom lines: in columns 31 to 54, eight each, or one after the other where one is wider than its column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"(-?\d+\.\d{3})"
#: Three numbers of three decimals each: where one ends the next may begin, with or without blanks.
_WIDE = rf"^.{{27}} {{3}}\s*{_NUMBER}\s*{_NUMBER}\s*{_NUMBER}(?!\d)"


def column(line: str, k: int) -> Column:
    """What stands in the column of x, y or z (0 to 2), by place alone."""
    return F.trim(F.substring(line, 31 + 8 * k, 8))


def places(line: str, other: list[Column]) -> tuple[list[Column], Column]:
    """x, y, z of a line, and by how many characters what follows them is moved to the right. A line whose numbers have
    three decimals is read whole, whatever their width; for others, the columns `other` hold."""
    point = lambda at: F.substring(line, at, 1) == "."
    fits = point(35) & point(43) & point(51) & ~F.substring(line, 55, 1).rlike(r"\d")
    wide = F.regexp_extract(line, _WIDE, 0)
    found = [F.when(fits, column(line, k).try_cast("double")).when(wide != "", F.regexp_extract(line, _WIDE, k + 1).try_cast("double")).otherwise(o) for k, o in enumerate(other)]
    return found, F.when(~fits & (wide != ""), F.length(wide) - 54).otherwise(0)
