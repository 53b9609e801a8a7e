"""op1 against all diagonals by both ways; the order of equal ids in op3; long words in op5's fit; long texts in op10."""

import hashlib
import itertools
import math
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from helpers import documents, frame, text

from cardlake.llm import op1_decontaminate as o1
from cardlake.llm import op3_token_shards as o3
from cardlake.llm import op5_language_id as o5
from cardlake.llm import op10_fingerprints as o10
from cardlake.llm.shared import shared_folder


def planted(seed):
    """Items of 1 to 40 tokens; documents that hold some of them, up to three times, whole or changed or in parts, among few other words."""
    rng = random.Random(seed)
    word = lambda n: f"w{rng.randrange(n)}"
    items = [[word(400) for _ in range(n)] for n in [1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 7, 9, 11, 13, 14, 15, 16, 20, 30, 40, 40]]
    items += [items[5], ["w1", "w1", "w1", "w1"], ["w2"] * 14, ["w1", "w2"] * 9]
    docs = []
    for _ in range(60):
        out = [word(400) for _ in range(rng.randrange(5))]
        for item in rng.sample(items, 3):
            for _ in range(rng.randrange(1, 4)):
                a = rng.randrange(len(item) // 3 + 1)
                part = item[a:] if rng.random() < 0.4 else item
                out += [word(50) if rng.random() < rng.choice([0, 0.1, 0.3]) else x for x in part] + [word(400) for _ in range(rng.randrange(4))]
        docs.append(" ".join(out))
    rows = [(i, t) for i, t in enumerate(docs)] + [(3, docs[7]), (None, docs[8]), (None, docs[8]), (None, docs[9]), (5, docs[5]), (100, None), (101, ""), (102, "w1")]
    return [(i, " ".join(x)) for i, x in enumerate(items)] + [(None, docs[0]), (300, None), (301, "..."), (2, " ".join(items[2]))], rows


def all_diagonals(items, rows):
    out = []
    for (d, t), (i, u) in itertools.product(rows, items):
        if t is None or u is None or i is None:
            continue
        (x, _), (y, _) = o1.tokens(pa.array([u])), o1.tokens(pa.array([t]))
        found = [f for s in range(-len(x) + 1, len(y)) if (f := o1.stretch(x, y, s))]
        if found:
            start, n, matched = min(found, key=lambda f: (-f[2], f[0], f[1]))
            out.append((d, i, start, n, matched, matched / len(x)))
    return out


@pytest.mark.parametrize("limit", [1 << 23, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_op1_is_all_diagonals(spark, seed, limit):
    items, rows = planted(seed)
    want = all_diagonals(items, rows)
    got = o1.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), limit).drop("text_hash").collect()
    assert len(want) > 150 and {1, 2, 3, 4} <= {r[4] for r in want}
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    least = o1.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), limit, min_item=5)
    long = {i for i, t in items if t and len(t.split()) >= 5}
    assert sorted(str((r.doc_id, r.item_id, r.doc_start)) for r in least.collect()) == sorted(str(r[:3]) for r in want if r[1] in long)


def test_op3_orders_rows_of_one_id(spark):
    """Whatever order rows come in, the shards are the same."""
    rows = [(4, f"text {i}") for i in range(30)] + [(None, f"none {i}") for i in range(30)] + [(1, "a"), (9, "b")]
    found = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        shards = o3.write_shards(frame(spark, rows, seed + 1), P.path("word_bpe_49k.json"), shared_folder(spark, "t"), shard=40)
        found.append(sorted(str(tuple(r)) for r in o3.read_shards(shards).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)


def test_op5_counts_pieces_of_long_words():
    v = o5.Pieces(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(2)
    p = rng.random(v.n + 2) * 1e-3
    p[-2], p[-1] = o5.UNSEEN, 0
    for word in ("▁whereas", "▁übergrößenträger", "▁of日x"):
        (at, chars) = next(o5._by_length([word]))
        lattice, n = v.lattice(chars), len(word)
        alpha = o5.forward(lattice, n, 1, p[:, None])[..., 0]
        beta = np.zeros_like(alpha)
        beta[n] = 1
        for a, b, which in lattice[::-1]:
            beta[a] += beta[b] * p[which]
        want = np.zeros(v.n + 2)
        for a, b, which in lattice:
            np.add.at(want, which[which >= 0], (alpha[a] * p[which] * beta[b] / alpha[n])[which >= 0])
        got = np.zeros(v.n + 2)
        np.add.at(got, *o5.long_counts(v, word, p))
        assert np.allclose(got, want, rtol=1e-9)
    which, often = o5.long_counts(v, "▁" + "ab" * 3000, p)
    spans = sum(c * len(names[w]) if (names := _names(v)) and w < v.n else c for w, c in zip(which.tolist(), often.tolist(), strict=True))
    assert math.isclose(spans, 6001, rel_tol=1e-6)  # each character is in one piece of a segmentation
    assert o5.fit_pieces(v, ["▁" + "ab" * 300], np.ones(1)).max() > 500 / v.n  # all are 1 / n before anything is learned


_known = {}


def _names(v):
    """The pieces by number."""
    if v.n not in _known:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        names = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        _known[v.n] = sorted(x for x in names if x.strip(o5.MARK))
    return _known[v.n]


def test_op5_learns_from_rows_without_an_id(spark):
    rows = [(None, text(random.Random(i), 20), "en" if i % 2 else "fr") for i in range(60)]
    one, two = (o5.fit(spark.createDataFrame(rows[::s], "doc_id long, text string, lang string").repartition(k), P.path("piece_bpe_32k.model"), sample=5) for s, k in ((1, 2), (-1, 5)))
    assert one.languages == two.languages == ["en", "fr"] and np.array_equal(one.p, two.p)


def test_op10_long_texts(spark, monkeypatch):
    monkeypatch.setattr(o10, "TEXT_BYTES", 100_000)
    rng = random.Random(4)
    rows = documents(n=20) + [(1000 + i, text(rng, 40_000)) for i in range(3)] + [(1003, "z" * 1_000_000)]
    got = {r.doc_id: r for r in o10.fingerprints(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        mine, other = (set(o10.digests(pa.array([x]))[0].tolist()) for x in (t, edited))
        assert got[i].near_edited == pytest.approx(len(mine & other) / len(mine | other) if mine | other else 1.0)
