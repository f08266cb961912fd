"""Value rules that results depend on: truthiness, rounding, JSON access. All are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attr(name: str, json: str | Column = "attributes") -> Column:
    """An attribute of a JSON column as text; objects and arrays as JSON text, JSON null as null."""
    return F.get_json_object(json, f"$.{name}")


def has_attr(name: str, json: str | Column = "attributes") -> Column:
    """Whether an attribute is there and true in a condition: not null, false, 0, '' (empty arrays and objects are true)."""
    v = attr(name, json)
    return F.coalesce(v.isNotNull() & ~v.isin("", "0", "0.0", "false", "-0", "-0.0"), F.lit(False))


def any_attr(*names: str, json: str | Column = "attributes") -> Column:
    """Whether any of the attributes is true in a condition."""
    out = F.lit(False)
    for n in names:
        out = out | has_attr(n, json)
    return out


def first_true(*columns: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def round_half_up(c: Column) -> Column:
    """Whole number, halves up."""
    return F.floor(c + 0.5)


def any_size(c: Column) -> Column:
    """Size of an array; 0 for null."""
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(c))
