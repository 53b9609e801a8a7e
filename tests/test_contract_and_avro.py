"""The contract's compiler, Avro by columns against a plain reader and writer, models as SQL, drift of many columns."""

import json
import random
import struct

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardlake.functions import contract, schema
from cardlake.operators import metrics as M
from cardlake.operators import model as B
from cardlake.sources import avro

KINDS = [("a", "bigint", False), ("b", "string", False), ("c", "double", True), ("d", "boolean", True), ("e", "string", True), ("f", "int", False)]


def put_long(n):
    n, out = (n << 1) ^ (n >> 63), bytearray()
    n &= 2**64 - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def plain(row, id_):
    """A record by the book; None where a required field is missing."""
    out = b"\0" + struct.pack(">I", id_)
    for (_, kind, nullable), v in zip(KINDS, row, strict=True):
        if v is None or v != v:
            if not nullable:
                return None
            out += b"\0"
            continue
        out += b"\2" if nullable else b""
        out += put_long(len(v.encode())) + v.encode() if kind == "string" else struct.pack("<d", v) if kind == "double" else bytes([v]) if kind == "boolean" else put_long(v)
    return out


def rows(n, seed=1):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice("ab é日😀\x00") for _ in range(rng.choice([0, 1, 5, 70, 300])))
    none = lambda v: None if rng.random() < 0.2 else v
    big = [0, 1, -1, 63, 64, -64, -65, 2**31 - 1, -(2**31), 2**63 - 1, -(2**63), 8191, 8192]
    return [(none(rng.choice(big)), text(), none(rng.choice([0.0, -1.5, 1e300, float("inf"), float("nan")])), none(rng.random() < 0.5), none(text()), rng.choice([0, -5, 2**31 - 1, -(2**31)])) for _ in range(n)]


def columns(data):
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.int32()]
    return [pa.array([r[i] for r in data], k) for i, k in enumerate(kinds)]


def test_records_are_by_the_book():
    data = rows(500)
    got = avro.encoded([k[1:] for k in KINDS], 7, columns(data))
    assert got.to_pylist() == [plain(r, 7) for r in data]
    assert avro.encoded([k[1:] for k in KINDS], 7, columns([])).to_pylist() == []
    sliced = [c.slice(100, 50) for c in columns(data)]
    assert avro.encoded([k[1:] for k in KINDS], 7, sliced).to_pylist() == [plain(r, 7) for r in data[100:150]]


def same(got, row):
    return got["ok"] and all((got[n] is None) if v is None or v != v else got[n] == v for (n, *_), v in zip(KINDS, row, strict=True))


def test_records_are_read_back_and_damage_is_seen():
    data = [r for r in rows(400, 2) if r[0] is not None]
    wire = [plain(r, 7) for r in data]
    got = avro.decoded(KINDS, pa.array(wire, pa.binary()), 7).to_pylist()
    assert all(same(g, r) for g, r in zip(got, data, strict=True))
    rng = random.Random(3)
    broken = [w[: rng.randrange(len(w))] for w in wire] + [w + b"x" for w in wire] + [None, b"", b"\0", b"\1" + wire[0][1:]]
    gone = avro.decoded(KINDS, pa.array(broken, pa.binary()), 7).to_pylist()
    assert not any(g["ok"] or g["b"] is not None for g in gone)
    assert not any(g["ok"] for g in avro.decoded(KINDS, pa.array(wire, pa.binary()), 8).to_pylist())
    assert all(g["ok"] for g in avro.decoded(KINDS, pa.array(wire, pa.binary()).slice(5, 20), None).to_pylist())
    one = [("a", "string", False)]
    head = b"\0\0\0\0\7"
    texts = [head + put_long(2) + b"\xff\xfe", head + put_long(-3) + b"abc", head + put_long(2**62) + b"abc", head + b"\xff" * 10, head + put_long(2) + "é".encode(), head + b"\xff" * 9 + b"\x01"]
    assert [g["ok"] for g in avro.decoded(one, pa.array(texts, pa.binary()), 7).to_pylist()] == [False, False, False, False, True, False]
    assert [g["ok"] for g in avro.decoded([("a", "int", False)], pa.array([head + put_long(2**31), head + put_long(-(2**31))], pa.binary()), 7).to_pylist()] == [False, True]
    assert [g["ok"] for g in avro.decoded([("a", "int", True)], pa.array([head + b"\4\2", head + b"\2\2", head + b"\0"], pa.binary()), 7).to_pylist()] == [False, True, True]
    assert avro.decoded(KINDS, pa.array([], pa.binary()), 7).to_pylist() == []


def test_random_bytes_never_crash():
    rng = np.random.default_rng(4)
    junk = [b"\0\0\0\0\7" + rng.integers(0, 256, rng.integers(0, 40), dtype=np.uint8).tobytes() for _ in range(3000)]
    for g, w in zip(avro.decoded(KINDS, pa.array(junk, pa.binary()), 7).to_pylist(), junk, strict=True):
        assert not g["ok"] or len(w) > 12


DOCUMENT = {
    "title": "Thing",
    "required": ["id", "size"],
    "properties": {
        "id": {"type": "string", "pattern": "^x", "minLength": 2, "maxLength": 3},
        "size": {"type": "integer", "minimum": 1},
        "kind": {"enum": ["a", "b"], "description": "Which"},
        "flag": {"const": True},
        "ratio": {"type": ["null", "number"], "maximum": 1, "x-says": "is too great"},
    },
}


def test_a_contract_is_compiled(spark):
    c = contract.compiled(DOCUMENT)
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in c.struct] == [("id", "string", False), ("size", "int", False), ("kind", "string", True), ("flag", "boolean", True), ("ratio", "double", True)]
    data = [("xy", 1, "a", True, 0.5), (None, None, None, None, None), ("y", 0, "c", False, 1.5), ("xabc", 2, "b", None, 1.0)]
    df = spark.createDataFrame(data, "id string, size int, kind string, flag boolean, ratio double")
    assert [r.v for r in df.select(c.violations(df.columns).alias("v")).collect()] == [
        [],
        ["id: is required", "size: is required"],
        ["flag: must be True", "id: is too short", "id: must match ^x", "kind: must be one of a, b", "ratio: is too great", "size: must be at least 1"],
        ["id: is too long"],
    ]
    assert df.select(c.violations(["none"]).alias("v")).first().v == []
    told = json.loads(c.avro())
    assert told["name"] == "Thing" and told["fields"][2] == {"name": "kind", "type": ["null", "string"], "doc": "Which", "default": None}
    for name, said in [("a", {"type": "array"}), ("b", {}), ("c", {"type": ["string", "number"]}), ("d", {"type": "string", "multipleOf": 2})]:
        with pytest.raises(ValueError, match=name):
            contract.compiled({"properties": {name: said}})
    with pytest.raises(ValueError, match="gone"):
        contract.compiled({"required": ["gone"], "properties": {}})


def test_a_stored_schema_is_checked(tmp_path, capsys):
    out = tmp_path / "t.avsc"
    run = lambda *more: contract.main(["--output", str(out), *more])
    assert run("--check") == 1
    assert run() == 0 and run("--check") == 0
    first = out.read_bytes()
    assert run() == 0 and out.read_bytes() == first == schema.avro_schema(schema.CONTRACT).encode()
    out.write_text(out.read_text() + " ")
    assert run("--check") == 1
    capsys.readouterr()


def test_models_are_sql(spark):
    rng = random.Random(5)
    data = [(rng.random(), rng.choice([None, 1.0, 2.0]), float(rng.randrange(4))) for _ in range(300)]
    df = spark.createDataFrame([(*r, float(r[0] > 0.5 or r[1] == 2.0)) for r in data], "x double, y double, z double, label double")
    model = B.fit(df, ["x", "y", "z"], maxIter=4, maxDepth=3)
    text = B.expression(model)
    got = B.scored(model, df).withColumn("printed", F.expr(text)).toPandas()
    assert np.allclose(got.probability, got.printed, atol=1e-12)
    own = got[["x", "y", "z", "probability"]]  # noqa: F841
    other = duckdb.sql(f"SELECT max(abs(probability - ({text}))) FROM own").fetchall()[0][0]  # and so in another engine
    assert other < 1e-12


@pytest.mark.parametrize("local", [100_000, 0])
def test_quantiles_of_many_columns(spark, monkeypatch, local):
    monkeypatch.setattr(M, "LOCAL", local)
    rng = np.random.default_rng(1)
    n = 20_000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": np.where(rng.random(n) < 0.97, 0.0, rng.random(n)), "d": np.round(rng.exponential(size=n), 2), "e": 3.0, "f": np.nan})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf).repartition(5)
    shares = [0.0, 0.001, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = M.exact_quantiles(df, list("abcdef"), shares)
    for x in "abcde":
        assert np.allclose(got[x], np.quantile(pdf[x].dropna(), shares), rtol=1e-12)
    assert got["f"] == []
    assert M.exact_quantiles(df.limit(1), ["e"], shares)["e"] == [3.0] * 7


def test_drift_of_ten_columns(spark):
    rng = np.random.default_rng(2)
    old, new = (pd.DataFrame({f"n{i}": rng.normal(i * shift, 1, 3000) for i in range(8)} | {"k0": rng.choice(["a", "b"], 3000, p=[0.5 + shift / 5, 0.5 - shift / 5]), "k1": rng.choice(["a", "b"], 3000)}) for shift in (0, 1))
    a, b = spark.createDataFrame(old), spark.createDataFrame(new)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else each stage counts as a job
    spark.sparkContext.setJobGroup("drift", "drift")
    try:
        got = {r.feature: r.psi for r in M.drift_table(a, b, [f"n{i}" for i in range(8)], ["k0", "k1"]).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("drift"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext._jsc.clearJobGroup()
    for name in old:
        if name[0] == "n":
            inner = np.unique(np.quantile(old[name], np.linspace(0, 1, 11)))[1:-1]
            x, y = (np.bincount(np.searchsorted(inner, d[name], "right"), minlength=10) / len(d) for d in (old, new))
        else:
            x, y = (d[name].value_counts(normalize=True).reindex(["a", "b"]).to_numpy() for d in (old, new))
        x, y = np.maximum(x, 1e-4), np.maximum(y, 1e-4)
        assert got[name] == pytest.approx(float(((y - x) * np.log(y / x)).sum()))
    assert jobs <= 6  # two passes for the edges, one for the bins; small tables that are sent to tasks count as jobs
