"""Array and map functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_product(arrays: Sequence[Column]) -> Column:
    """Cartesian product of the arrays of one row, first array slowest."""
    if not arrays:
        return F.array(F.array())
    result = F.transform(arrays[0], lambda x: F.array(x))
    for values in arrays[1:]:
        result = F.flatten(F.transform(result, lambda prefix: _extensions(prefix, values)))  # noqa: B023
    return result


def _extensions(prefix: Column, values: Column) -> Column:
    return F.transform(values, lambda x: F.concat(prefix, F.array(x)))


def pluck(rows: Column, i: int = 0, limit: int | None = None) -> Column:
    """Element `i` of each inner array, of the first `limit` rows or all."""
    taken = F.slice(rows, 1, limit) if limit else rows
    return F.transform(taken, lambda r: F.get(r, F.lit(i)))


def sort_elements(values: Column, key: Callable[[Column], Column] = lambda v: v, descending: bool = False) -> Column:
    """Sort an array by a key of its elements; equal keys keep their order."""
    # Position breaks ties, which makes the sort stable.
    tagged = F.transform(values, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v")))

    def compare(a: Column, b: Column) -> Column:
        low, high = (b, a) if descending else (a, b)
        return (
            F.when(low["k"] < high["k"], -1)
            .when(low["k"] > high["k"], 1)
            .when(a["i"] < b["i"], -1)
            .when(a["i"] > b["i"], 1)
            .otherwise(0)
        )

    return F.transform(F.array_sort(tagged, compare), lambda t: t["v"])


def map_table(m: Column, f: Callable[[Column], Column] | None = None) -> Column:
    """A map as an array of (key, value) structs, values passed through `f` where given."""
    return F.map_entries(m if f is None else F.transform_values(m, lambda _, v: f(v)))


def last_value(pairs: Column, key: Column, id_field: str = "id", value_field: str = "value") -> Column:
    """The value of the last `{id, value}` pair with this id; null where there is none."""
    matches = F.filter(pairs, lambda p: p[id_field] == key)
    return F.get(matches, F.size(matches) - 1)[value_field]
