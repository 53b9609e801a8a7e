"""Ball k-means, jump shards and fill-in-middle against plain versions and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import documents, frame
from pyspark.sql import functions as F

from cardlake.llm import op11_ball_kmeans as o11
from cardlake.llm import op12_jump_shards as o12
from cardlake.llm import op13_fill_in_middle as o13
from cardlake.llm import registry
from cardlake.llm.shared import shared_folder

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>, v string, cluster int"


def plain(v):
    return None if v != v else v


@pytest.mark.parametrize("name", ["op11_ball_kmeans", "op12_jump_shards", "op13_fill_in_middle"])
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.sql(registry.SQL[name]).to_arrow_table().select(names)
    kinds = {"int64": "bigint", "int32": "int"}
    assert {f.name: kinds.get(str(f.type), str(f.type)) for f in want.schema} == dict(got.dtypes)
    assert sorted(map(str, (tuple(r.values()) for r in want.to_pylist()))) == sorted(str(tuple(r[c] for c in names)) for r in got.collect())


def lloyd(rows, clusters, rounds, dims, scale):
    """rows: (id, vector)."""
    kept = []
    for i, x in rows:
        if x is not None and len(x) == dims and all(v is not None and np.isfinite(v) for v in x):
            x = [int(np.floor(scale * v)) for v in x]
            if max(map(abs, x)) <= o11.LIMIT:
                kept.append((i, x))
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    first = sorted(((name(i), np.array(x, "<i4").tobytes(), x) for i, x in kept))[:clusters]
    centroids = [x for _, _, x in first]
    square = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x: min((square(x, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        for k in set(of):
            members = [x for (_, x), c in zip(kept, of, strict=True) if c == k]
            centroids[k] = [sum(v) // len(members) for v in zip(*members, strict=True)]
    return [(i, *near(x)[::-1]) for i, x in kept], centroids


@pytest.mark.parametrize("seed", range(4))
def test_ball_kmeans_is_lloyd(spark, seed):
    rng = random.Random(seed)
    dims, scale = 5, (64.0, 2.0, 3.0, 1.0)[seed]  # few values: many ties
    rows = [(rng.randrange(80), [rng.gauss(rng.randrange(3), 0.7) for _ in range(dims)]) for _ in range(200)]
    rows += [(300, rows[0][1]), (rows[1][0], rows[1][1]), (None, rows[2][1])] + [(1000 + i, [0.5] * dims) for i in range(90)]
    rows += [(400, None), (401, []), (402, [1.0] * 4), (403, [1.0] * 6), (404, [1.0, None, 1.0, 1.0, 1.0]), (405, [float("nan")] * 5), (406, [float("-inf")] * 5), (407, [1e300] * 5), (408, [1e9] + [0.0] * 4)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, x, "own", 7) for i, x in rows], KIND).repartition(3)
    got, centroids = o11.cluster(df, 7, 3, dims=dims, scale=scale)
    want, expected = lloyd(rows, 7, 3, dims, scale)
    assert sorted(map(str, want)) == sorted(str((r.vec_id, r.cluster, r.distance)) for r in got.collect())
    assert centroids.tolist() == expected


def test_ball_kmeans_small_tables(spark):
    empty, centroids = o11.cluster(spark.createDataFrame([], KIND), 4)
    assert empty.count() == 0 and len(centroids) == 0
    two = spark.createDataFrame([(1, [1.0] * 64, "", 0), (2, [2.0] * 64, "", 0)], KIND)
    got, centroids = o11.cluster(two, 16)
    assert sorted((r.vec_id, r.distance) for r in got.collect()) == [(1, 0), (2, 0)] and len(centroids) == 2


def test_balls_compare_few():
    """Vectors in the stable core are compared with nothing, others with the centroids within reach only."""
    rng = np.random.default_rng(3)
    centroids = rng.integers(-500, 500, (30, 8))
    x = centroids[rng.integers(0, 30, 3000)] + rng.integers(-60, 60, (3000, 8))
    plain = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    own = plain.argmin(axis=1)
    radii = {c: int(plain[own == c, c].max()) for c in range(30)}
    best, distance, compared = o11.nearest(x, own, centroids, o11.neighbours(centroids, radii))
    assert (best == own).all() and (distance == plain.min(axis=1)).all()
    assert compared < 3000  # of 87,000


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def name(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:16], 16)


def test_jump_is_the_plain_one():
    keys = np.array([0, 1, 2**63, 2**64 - 1, *(name(i) for i in range(500))], dtype=np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert o12.jump(keys, n).tolist() == [jump(int(k), n) for k in keys]
    for n in range(1, 40):  # only into the new one
        a, b = o12.jump(keys, n), o12.jump(keys, n + 1)
        assert ((a == b) | (b == n)).all()


def test_appended_shards_take_their_part():
    keys = np.array([name(i) for i in range(40_000)], dtype=np.uint64)
    a, b = o12.jump(keys, 16), o12.jump(keys, 20)
    assert abs((a != b).mean() - 4 / 20) < 0.01
    assert np.ptp(np.bincount(a)) < 400  # 2,500 each


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(o12, "COPIES", 7)
    rows = [*documents(), (3, "other"), (None, "x"), (None, "x"), (None, "y"), (None, None), *[(9, "hot")] * 40]
    got = o12.slots(frame(spark, rows), 5).collect()
    want = Counter()
    for i, t in rows:
        data = (t or "").encode()
        want[i, len(data) + 1, zlib.crc32(data), jump(name(i), 5), jump(name(i), 6)] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    for s in range(5):
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in mine]
        assert ids == sorted(ids)
    assert o12.slots(frame(spark, rows).where("false"), 5).collect() == []


def test_shards_of_whole_rows(spark):
    df = frame(spark, documents()).withColumn("shard", F.lit("own"))
    folder = shared_folder(spark, "sharded")
    o12.write(df, folder, 5)
    back = spark.read.parquet(folder)
    assert sorted(str((r.doc_id, r.text, r.kept, r.shard)) for r in back.collect()) == sorted(str((i, t, "k", jump(name(i), 5))) for i, t in documents())
    out = {r.doc_id: (r.old_shard, r.shard) for r in o12.moves(df, 5, 7).collect()}
    assert out == {i: (jump(name(i), 5), jump(name(i), 7)) for i, _ in documents() if jump(name(i), 5) != jump(name(i), 7)}


def middle(i, t):
    t = t or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    s = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(s[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, t
    p, m, x = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{x}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{x}<M>{m}"


def test_fill_in_middle(spark):
    odd = ["<", "<P", "a <S> b", "P> <M", "x" * 70_000 + " ü" * 90_000, "\x0b\x0c\r\n", "\x1f\x85\xa0 ​", "a\x00b \x00", "é 👩‍👩‍👧 \U0010ffff"]
    rows = [*documents(), *((100 + 20 * k + j, t) for k, t in enumerate(odd) for j in range(20)), (None, "null id here"), (None, "null id here"), (7, None)]
    df = frame(spark, rows).withColumn("form", F.lit("own")).withColumn("a.b", F.lit(1))
    got = o13.restore(o13.fill_in_middle(df))
    assert got.columns == ["doc_id", "text", "source", "n_chars", "n_tokens", "kept", "a.b", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    found = got.collect()
    assert sorted(str((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in found) == sorted(str((i, t, *middle(i, t))) for i, t in rows)
    assert all(r.restored == (r.text or "") for r in found)
    assert {r.form for r in found} == {"plain", "spm", "psm"}
    assert o13.fill_in_middle(df.where("false")).collect() == []


def test_long_texts_are_cut_part_by_part(monkeypatch):
    monkeypatch.setattr(o13, "STEP", 7)
    con, rng = o13._connection(), random.Random(8)
    for i in range(300):
        t = "".join(rng.choice(["a", "é", "日本", " ", "  ", "\n", "xyz"]) for _ in range(rng.randrange(1, 60))) + rng.choice(["", "", " ", "<S>"])
        assert o13.cut_long(con, i, t, {"seed": "42", "rate": 50, "spm": 80}) == middle(i, t)
    assert o13.cut_long(con, None, " a", {"seed": "42", "rate": 50, "spm": 80}) == middle(None, " a")


def test_fill_in_middle_of_very_long_texts(spark):
    rows = [(i, "wörd \t x" * 1_200_000 + str(i)) for i in range(4)] + [(9, "y" * 9_000_000), (10, "short one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = o13.restore(o13.fill_in_middle(df)).drop("text").collect()
    want = {i: middle(i, t) for i, t in rows}
    assert {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got} == want
    assert all(r.restored == dict(rows)[r.doc_id] for r in got)


def test_shares_of_forms(spark):
    df = frame(spark, documents())
    assert {r.form for r in o13.fill_in_middle(df, rate=0).collect()} == {"plain"}
