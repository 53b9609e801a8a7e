"""The event contract, as compiled from its file: one StructType, its checks, its Avro form and compatibility of versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardlake.functions import contract

_COMPILED = contract.load()
REQUIRED, CONTRACT = _COMPILED.required, _COMPILED.struct


def violations(columns: list[str]) -> Column:
    """All broken rules of a row, sorted by path."""
    return _COMPILED.violations(columns)


def reason(columns: list[str]) -> Column:
    """The first broken rule, or null."""
    return F.try_element_at(violations(columns), F.lit(1))


def complete() -> Column:
    """Whether all required fields but the schema's version are there."""
    out = F.lit(True)
    for n in REQUIRED[1:]:
        out = out & F.col(n).isNotNull()
    return out


def avro_schema(schema: T.StructType, name: str = "Transaction", namespace: str = contract.NAMESPACE) -> str:
    return contract.Contract(name, None, schema, [], []).avro(namespace)


def is_current(text: str, schema: T.StructType, name: str = "Transaction", namespace: str = contract.NAMESPACE) -> bool:
    """Whether a stored Avro schema is, byte by byte, what the contract gives now."""
    return text == avro_schema(schema, name, namespace)


WIDENS = {("int", "bigint"), ("int", "double"), ("bigint", "double"), ("float", "double"), ("int", "float"), ("bigint", "float")}


def reads_old_data(old: T.StructType, new: T.StructType) -> list[str]:
    """Why a reader with the new schema can't read data of the old one; empty if it can."""
    before = {f.name: f for f in old}
    out = []
    for f in new:
        was = before.get(f.name)
        if was is None:
            if not f.nullable:
                out.append(f"{f.name}: new and required")
        elif was.nullable and not f.nullable:
            out.append(f"{f.name}: was nullable")
        elif (a := was.dataType.simpleString()) != (b := f.dataType.simpleString()) and (a, b) not in WIDENS:
            out.append(f"{f.name}: {a} isn't read as {b}")
    return out
