"""A contract in JSON Schema, compiled to a StructType, to rules as Column expressions, and to an Avro schema.

``python -m cardlake.functions.contract`` writes the Avro schema of the contract file, or with --check says by its exit code whether a stored one is current.

A property that isn't required may be null. Its type is one of string, number, integer and boolean (with or without null), or that of its const or enum.
Rules are const, enum, pattern, minLength, maxLength, minimum and maximum; x-says is what is said of a value that breaks one. Formats and
annotations aren't checked; a keyword that isn't known is an error, so that no rule is lost unseen."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE = Path(__file__).with_name("contract.json")
TYPES: dict[str, T.DataType] = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.IntegerType(), "boolean": T.BooleanType()}
AVRO = {"string": "string", "double": "double", "int": "int", "bigint": "long", "boolean": "boolean"}
NAMESPACE = "payments"
#: What breaks a rule, by its keyword, and what is said then.
RULES: dict[str, tuple[Callable[[Column, object], Column], str]] = {
    "const": (lambda c, x: c != F.lit(x), "must be {}"),
    "enum": (lambda c, x: ~c.isin(*x), "must be one of {}"),
    "pattern": (lambda c, x: ~c.rlike(x), "must match {}"),
    "minLength": (lambda c, x: F.length(c) < x, "is too short"),
    "maxLength": (lambda c, x: F.length(c) > x, "is too long"),
    "minimum": (lambda c, x: c < x, "must be at least {}"),
    "maximum": (lambda c, x: c > x, "must be at most {}"),
}
PLAIN = {"type", "format", "title", "description", "default", "examples", "$comment"}


@dataclass(frozen=True)
class Rule:
    path: str
    keyword: str
    value: object
    said: str

    def broken(self, column: Column) -> Column:
        return RULES[self.keyword][0](column, self.value)


@dataclass(frozen=True)
class Contract:
    name: str
    doc: str | None
    struct: T.StructType
    required: list[str]
    rules: list[Rule]

    def violations(self, columns: list[str]) -> Column:
        """All broken rules of a row, as `path: what is wrong`, sorted; of columns that the contract doesn't name nothing is said."""
        found = [F.when(F.col(n).isNull(), F.lit(f"{n}: is required")) for n in self.required if n in columns]
        found += [F.when(r.broken(F.col(r.path)), F.lit(f"{r.path}: {r.said}")) for r in self.rules if r.path in columns]
        return F.array_sort(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")

    def avro(self, namespace: str = NAMESPACE) -> str:
        """The Avro schema: the same bytes for the same contract."""
        fields = []
        for f in self.struct:
            kind, doc = AVRO[f.dataType.simpleString()], f.metadata.get("comment")
            field = {"name": f.name, "type": ["null", kind] if f.nullable else kind}
            fields.append(field | ({"doc": doc} if doc else {}) | ({"default": None} if f.nullable else {}))
        head = {"type": "record", "name": self.name, "namespace": namespace} | ({"doc": self.doc} if self.doc else {})
        return json.dumps(head | {"fields": fields}, indent=2) + "\n"


def _type(name: str, said: dict) -> T.DataType:
    if "type" in said:
        kinds = [k for k in ([said["type"]] if isinstance(said["type"], str) else said["type"]) if k != "null"]
    else:
        examples = [said["const"]] if "const" in said else said.get("enum", [])
        kinds = sorted({"boolean" if isinstance(x, bool) else "integer" if isinstance(x, int) else "number" if isinstance(x, float) else "string" for x in examples if x is not None})
    if len(kinds) != 1 or kinds[0] not in TYPES:
        raise ValueError(f"{name}: needs one type of {', '.join(TYPES)}, not {kinds}")
    return TYPES[kinds[0]]


def compiled(document: dict) -> Contract:
    properties, required = document["properties"], list(document.get("required", []))
    if missing := [n for n in required if n not in properties]:
        raise ValueError(f"required, but no property: {', '.join(missing)}")
    fields, rules = [], []
    for name, said in properties.items():
        if unknown := [k for k in said if k not in RULES and k not in PLAIN and not k.startswith("x-")]:
            raise ValueError(f"{name}: {', '.join(unknown)} isn't known")
        about = {"comment": said["description"]} if "description" in said else {}
        fields.append(T.StructField(name, _type(name, said), name not in required, about))
        both = "minimum" in said and "maximum" in said
        for keyword, (_, text) in RULES.items():
            if keyword in said:
                value = said[keyword]
                text = f"must be from {said['minimum']} to {said['maximum']}" if both and keyword in ("minimum", "maximum") else text
                told = text.format(", ".join(map(str, value)) if isinstance(value, list) else value)
                rules.append(Rule(name, keyword, value, said.get("x-says", told)))
    return Contract(document.get("title", "Record"), document.get("description"), T.StructType(fields), required, rules)


def load(path: str | Path = FILE) -> Contract:
    return compiled(json.loads(Path(path).read_text(encoding="utf-8")))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Writes the Avro schema of a contract, or checks a stored one.")
    parser.add_argument("--schema", default=str(FILE))
    parser.add_argument("--output", required=True)
    parser.add_argument("--check", action="store_true", help="write nothing; 1 if the output isn't what the contract gives now")
    args = parser.parse_args(argv)
    text, out = load(args.schema).avro(), Path(args.output)
    if args.check:
        current = out.exists() and out.read_text(encoding="utf-8") == text
        print(f"{out} is {'current' if current else 'not current'}", file=sys.stdout if current else sys.stderr)
        return 0 if current else 1
    out.write_text(text, encoding="utf-8")
    return 0


if __name__ == "__main__":
    sys.exit(main())
