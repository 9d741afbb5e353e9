"""Small helpers for expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between words: space and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where a lambda in it uses the value often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Runs of other characters than blanks; none for null."""
    return let(strip(F.coalesce(text, F.lit(""))), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RUN)))


def named(names: list[str]) -> list[Column]:
    """Columns by their whole names, whatever characters these have."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def packed(docs: DataFrame, without: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """The columns of ``docs`` in one named ``row``, and ``columns`` beside it, so that names cannot clash."""
    row = named([c for c in docs.columns if c not in without]) or [F.lit(0).alias("none")]
    return docs.select(F.struct(*row).alias("row"), *(c.alias(n) for n, c in columns.items()))


def unpacked(rows: DataFrame, names: list[str], new: dict[str, Column]) -> DataFrame:
    """The packed columns ``names``, replaced by ``new`` where it has the name; the rest of ``new`` follows."""
    old = [new[n].alias(n) if n in new else F.col("row").getField(n).alias(n) for n in names]
    return rows.select(*old, *(c.alias(n) for n, c in new.items() if n not in names))
