"""Nested access, display templates and links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE = r"(http://\S+?\.(jpg|png|gif|jpeg))"


def dotted(schema: T.DataType, path: str, value: Column | None = None) -> tuple[Column, T.DataType | None]:
    """Value and type at a dotted path.

    At each level the shortest run of path parts that names a field is taken, so
    names that contain dots work. Arrays are mapped over. An unknown path gives a
    null of unknown type (``None``).
    """
    parts = path.split(".")
    if isinstance(schema, T.ArrayType):
        inner = dotted(schema.elementType, path, F.lit(None))[1]
        if inner is None:
            return F.lit(None), None
        return (
            F.transform(value, lambda e: dotted(schema.elementType, path, e)[0]),
            T.ArrayType(inner),
        )
    if isinstance(schema, T.MapType):
        return F.try_element_at(value, F.lit(path)), schema.valueType
    if not isinstance(schema, T.StructType):
        return F.lit(None), None
    names = schema.fieldNames()
    for cut in range(1, len(parts) + 1):
        name = ".".join(parts[:cut])
        if name in names:
            kind = schema[name].dataType
            found = F.col(f"`{name}`") if value is None else value.getField(name)
            rest = ".".join(parts[cut:])
            return dotted(kind, rest, found) if rest else (found, kind)
    return F.lit(None), None


def get_path(df: DataFrame, path: str) -> Column:
    return dotted(df.schema, path)[0]


def _shown(value: Column, kind: T.DataType | None) -> Column:
    """Text of one value, or null where the template skips it."""
    if kind is None:
        return F.lit(None).cast("string")
    if isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(value, lambda e: F.coalesce(e.cast("string"), F.lit(""))), ", ")
        return F.when(F.size(value) > 0, text)
    text = value.cast("string")
    shown = text != ""
    if isinstance(kind, T.NumericType):
        shown = shown & (value != 0)
    if isinstance(kind, T.BooleanType):
        shown = shown & value
    return F.when(shown, text)


def display_lines(df: DataFrame, template: Sequence[Sequence[Mapping[str, str]]]) -> Column:
    """Record text from a template: lines of ``pre + value + post``.

    A missing, empty, zero or false value drops its ``pre`` and ``post``; lists
    are joined by ``", "``; without ``post`` a blank follows. Each non-empty line
    loses one blank on either side and a final comma, and ends in ``<br />``. A
    record for which no line is left shows as JSON.
    """
    lines = []
    for line in template:
        pieces = []
        for item in line:
            value, kind = dotted(df.schema, item["field"])
            text = F.concat(
                F.lit(item.get("pre") or ""), _shown(value, kind), F.lit(item.get("post") or " ")
            )
            pieces.append(F.coalesce(text, F.lit("")))
        whole = F.concat(*pieces)
        for edge in (r"^\s", r"\s\z", r",\z"):
            whole = F.regexp_replace(whole, edge, "")
        lines.append(F.when(F.concat(*pieces) != "", F.concat(whole, F.lit("<br />"))).otherwise(""))
    text = F.concat(*lines)
    return F.when(text != "", text).otherwise(F.to_json(F.struct("*")))


def first_image(*columns: str) -> Column:
    """First image link in the record's JSON text, null when there is none."""
    record = F.to_json(F.struct(*(columns or ("*",))))
    found = F.regexp_extract(record, IMAGE, 1)
    return F.when(found != "", found)


def file_url(path: Column) -> Column:
    return F.concat(F.lit("file://"), F.translate(path, "\\", "/"))
