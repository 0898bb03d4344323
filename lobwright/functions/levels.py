"""Access to book levels, as SQL text.

A snapshot table holds its levels either wide (``bid_3_size``) or as ``bids``/``asks``, ``array<struct<price,size>>`` with
the best level first.  Formulas over single levels take whichever form the table has: over a wide file only the level
columns a formula names are read.  Operators that fold or compare whole sides need the arrays.  Formulas are SQL text
because a plan of a few hundred expressions is then one call to the JVM per column rather than one per operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOOK_LEVELS = 20
SIDES = ("bid", "ask")


def add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with columns given as SQL text."""
    return df.selectExpr("*", *[f"{sql} as {name}" for name, sql in columns.items()])


class Levels:
    """Level access in the form ``columns`` hold."""

    def __init__(self, columns):
        self.wide = "bid_0_price" in columns

    def px(self, side: str, level: int) -> str:
        return f"{side}_{level}_price" if self.wide else f"{side}s[{level}].price"

    def sz(self, side: str, level: int) -> str:
        return f"{side}_{level}_size" if self.wide else f"{side}s[{level}].size"

    def depth(self, side: str, levels: int) -> str:
        """Sum of the first sizes; a missing size counts as nothing."""
        return "(" + " + ".join(f"coalesce({self.sz(side, i)}, 0D)" for i in range(levels)) + ")"


ARRAYS = Levels(("bids", "asks"))
px, sz, depth_sql = ARRAYS.px, ARRAYS.sz, ARRAYS.depth


def price(side: str, level: int) -> Column:
    return F.expr(px(side, level))


def size(side: str, level: int) -> Column:
    return F.expr(sz(side, level))


def depth(side: str, levels: int) -> Column:
    return F.expr(depth_sql(side, levels))


def any_level(side: str, test: str) -> Column:
    """Whether ``test`` on ``l.price`` / ``l.size`` holds at some level; an unknown counts as no."""
    return F.expr(f"exists({side}s, l -> coalesce({test}, false))")
