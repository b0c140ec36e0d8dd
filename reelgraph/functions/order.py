"""Sort orders with the null places that the catalog's lists have: last upwards, first downwards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def up(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def down(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def ordering(text: str, tie: str = "-id", last: Iterable[str] = ()) -> list[Column]:
    """`name` upwards, `-name` downwards, then the tie-break; nulls of the columns in `last` come last either way."""
    one = lambda t: F.col(t.lstrip("-")).desc_nulls_last() if t.startswith("-") and t[1:] in last else down(t[1:]) if t.startswith("-") else up(t)
    return [one(t) for t in (text, tie)]


def allowed(given: str | None, names: Iterable[str], default: str) -> str:
    """`given` if it is one of the names, upwards or with `-` downwards; else the list's default."""
    return given if given and given.removeprefix("-") in set(names) else default


def listed(rows: DataFrame, by: str, order: str | list[str] | None, names: Iterable[str], default: str, last: Iterable[str] = ()) -> DataFrame:
    """Adds the place of each row in its own list, in an order by name (`allowed`). For a list of orders a row comes once for
    each, named in `sorted`: rows are computed and dealt once, and only sorted anew."""
    by_name = lambda o: ordering(allowed(o, names, default), last=last)
    if order is None or isinstance(order, str):
        return placed(rows, by, by_name(order))
    out, places = rows, [f"place {k}" for k in range(len(order))]
    for one, name in zip(order, places, strict=True):
        out = placed(out, by, by_name(one), name)
    if not order:
        return rows.limit(0).withColumns({"sorted": F.lit(""), "place": F.lit(0)})
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("sorted", "place")], F.inline(F.array(*[F.struct(F.lit(o).alias("sorted"), F.col(f"`{p}`").alias("place")) for o, p in zip(order, places, strict=True)])))


def placed(rows: DataFrame, by: str | tuple[str, ...], order: list[Column], name: str = "place") -> DataFrame:
    """Adds the place of each row in its own list, from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)))
