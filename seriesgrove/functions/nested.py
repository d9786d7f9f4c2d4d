"""Nested values: dot paths, flattening, cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_path(path: str) -> str:
    """``A.B[0].(0010,0020)`` as a JSON path; hex tags are keys of eight digits."""
    path = re.sub(r"\(([0-9A-Fa-f]{4}),([0-9A-Fa-f]{4})\)", lambda m: (m[1] + m[2]).upper(), path)
    return "$." + path


def steps(path: str) -> list[tuple[str | None, str | None, int | None]]:
    """The steps of a header path as (name, tag of eight hex digits, index), one of them set."""
    out: list[tuple[str | None, str | None, int | None]] = []
    for m in re.finditer(r"\(([0-9A-Fa-f]{4}),([0-9A-Fa-f]{4})\)|\[(\d+)\]|([^.\[\]()]+)|(\.)|(.)", path):
        if m[6]:
            raise ValueError(f"{path!r} is no header path")
        if m[1]:
            out.append((None, (m[1] + m[2]).upper(), None))
        elif m[3]:
            out.append((None, None, int(m[3])))
        elif m[4]:
            out.append((m[4], None, None))
    return out


def lookup(column: str, path: str) -> Column:
    """The text at a dot path of a JSON column; null when missing."""
    return F.get_json_object(column, json_path(path))


def flatten_json(rows: DataFrame, column: str) -> DataFrame:
    """The other columns, with a row (key, value) per top-level key."""
    keys = [c for c in rows.columns if c != column]
    return rows.select(*keys, F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))


def flatten_struct(rows: DataFrame) -> DataFrame:
    """Nested struct columns as dot-named flat columns."""

    def walk(kind: T.StructType, prefix: tuple[str, ...]) -> list[Column]:
        out = []
        for f in kind.fields:
            at = (*prefix, f.name)
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, at)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in at)).alias(".".join(at)))
        return out

    return rows.select(*walk(rows.schema, ()))


def expand_struct(rows: DataFrame) -> DataFrame:
    """The inverse of flatten_struct."""

    def build(names: list[tuple[list[str], str]]) -> list[Column]:
        out, groups = [], {}
        for parts, full in names:
            groups.setdefault(parts[0], []).append((parts[1:], full))
        for head, rest in groups.items():
            out.append((F.col(f"`{rest[0][1]}`") if rest[0][0] == [] else F.struct(*build(rest))).alias(head))
        return out

    return rows.select(*build([(c.split("."), c) for c in rows.columns]))


def cleanse(rows: DataFrame) -> DataFrame:
    """NaN to null; dates and timestamps to ISO text."""
    out = []
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(c.alias(f.name))
    return rows.select(*out)
