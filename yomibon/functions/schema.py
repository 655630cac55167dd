"""Types of Arrow-batched functions, made without a session, as modules are imported before there is one."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(fields: str) -> T.StructType:
    """`name type, name type` with simple types; `array<type>` too."""
    found = T.StructType()
    for field in fields.split(","):
        name, kind = field.split()
        inner = kind.removeprefix("array<").removesuffix(">")
        found = found.add(name, T.ArrayType(T.StructType().add("x", inner)["x"].dataType) if kind != inner else kind)
    return found


def rows(fields: str) -> T.ArrayType:
    return T.ArrayType(struct(fields))


LONGS = T.ArrayType(T.LongType())
