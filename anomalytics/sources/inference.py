"""Types of an unknown CSV table, from all of its rows.

Every column is read as text and folded over a small lattice in one distributed aggregation:

    BOOLEAN    BIGINT < DOUBLE    DATE    TIMESTAMP        everything < STRING

A column gets the least type that holds all of its values, so a single odd value in the last row counts. The second
read casts; nothing is sampled, so no value turns into null. A column without any value stays text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: a leading zero makes a code (a zip code, say) of what would be a number
_WHOLE = r"^\s*[+-]?(0|[1-9][0-9]*)\s*$"
_NUMBER = r"^\s*[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_DATE = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\s*$"
_TIME = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?\s*$"
#: type -> the text that is one of it
SHAPES = {
    "boolean": lambda c: F.lower(F.trim(c)).isin("true", "false"),
    "bigint": lambda c: c.rlike(_WHOLE) & F.trim(c).try_cast("bigint").isNotNull(),
    "double": lambda c: c.rlike(_NUMBER) & F.trim(c).try_cast("double").isNotNull(),
    "date": lambda c: c.rlike(_DATE) & F.trim(c).try_cast("date").isNotNull(),
    "timestamp_ntz": lambda c: c.rlike(_TIME) & F.trim(c).try_cast("timestamp_ntz").isNotNull(),
}
#: a type and the shapes that fit it, least type first
LATTICE = (("boolean", ("boolean",)), ("bigint", ("bigint",)), ("double", ("bigint", "double")), ("date", ("date",)),
           ("timestamp_ntz", ("timestamp_ntz",)))


def _is(column: Column, shapes: tuple[str, ...]) -> Column:
    out = SHAPES[shapes[0]](column)
    for shape in shapes[1:]:
        out = out | SHAPES[shape](column)
    return out


def infer_schema(raw: DataFrame) -> StructType:
    """The schema of a table of text columns: one aggregation over all rows, one number per column and type."""
    counts = []
    for i, name in enumerate(raw.columns):
        c = F.col(f"`{name}`")
        counts.append(F.count(c).alias(f"n{i}"))
        counts += [F.count_if(F.coalesce(_is(c, shapes), F.lit(False))).alias(f"n{i}_{kind}") for kind, shapes in LATTICE]
    found = raw.agg(*counts).first() if raw.columns else {}

    def kind_of(i: int) -> str:
        return next((kind for kind, _ in LATTICE if found[f"n{i}"] and found[f"n{i}_{kind}"] == found[f"n{i}"]), "string")

    return StructType([StructField(name, _parse_datatype_string(kind_of(i))) for i, name in enumerate(raw.columns)])


def typed(raw: DataFrame, schema: StructType) -> DataFrame:
    """``raw`` with its text cast to the types of ``schema``, by position."""
    return raw.select(*[
        (F.col(f"`{f.name}`") if f.dataType.simpleString() == "string" else F.trim(F.col(f"`{f.name}`")).cast(f.dataType)).alias(f.name)
        for f in schema])
