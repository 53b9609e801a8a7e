"""The fits of operators 5 and 8 against plain ones, and what they get right on documents that they haven't seen."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from cardlake.llm import op5_language_id as o5
from cardlake.llm import op8_toxicity as o8

SF = "/root/testdata/sf0.1"


def segmentations(word, pieces):
    """All ways to cut a word into pieces; a character that is no piece stands for itself."""
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        if word[:k] in pieces or k == 1:
            for rest in segmentations(word[k:], pieces):
                yield (word[:k], *rest)


def test_em_equals_a_plain_one():
    v = o5.Pieces(P.path("piece_bpe_32k.model"))
    names = {}
    words, counts = ["▁the", "▁then", "▁日x", "▁hat", "▁thehat"], np.array([5.0, 2.0, 1.0, 3.0, 1.0])
    for (at, chars) in o5._by_length(words):
        for a, b, which in v.lattice(chars):
            for row, k in zip(at, which.tolist()):
                if 0 <= k < v.n:
                    names[words[row][a:b]] = k
    p = {x: 1 / v.n for x in names}
    weight = lambda s: math.prod(p.get(x, o5.UNSEEN) for x in s)
    for _ in range(4):
        seen = Counter()
        for w, n in zip(words, counts):
            ways = list(segmentations(w, names))
            whole = sum(map(weight, ways))
            for s in ways:
                for x in s:
                    seen[x] += n * weight(s) / whole
        total = sum(seen[x] for x in names) + o5.SMOOTH * v.n
        p = {x: (seen[x] + o5.SMOOTH) / total for x in names}
    got = o5.fit_pieces(v, words, counts)
    assert len(names) > 8 and all(abs(got[k] / p[x] - 1) < 1e-9 for x, k in names.items())


def test_noisy_or_weights_are_the_best():
    """No weight can be moved to make the labels likelier, by a plain likelihood of noisy-or documents."""
    rng = random.Random(7)
    docs = [[[rng.randrange(5) for _ in range(rng.randrange(1, 3))] for _ in range(rng.randrange(1, 4))] for _ in range(200)]
    labels = [int(any(0 in s for s in d) if rng.random() < 0.9 else rng.random() < 0.5) for d in docs]
    rows = {(i, y, j, f) for i, (d, y) in enumerate(zip(docs, labels)) for j, s in enumerate(d) for f in s}
    doc, toxic, sentence, which = map(np.array, zip(*sorted(rows)))
    w = o8._train(doc, toxic, sentence, which, 5, steps=4000)
    share = {y: len(labels) / (2 * labels.count(y)) for y in (0, 1)}

    def loss(w):
        out = 0.0
        for d, y in zip(docs, labels):
            none = math.prod(1 - 1 / (1 + math.exp(-(o8.BIAS + sum(w[f] for f in set(s))))) for s in d)
            out -= share[y] * math.log(max(1 - none if y else none, 1e-12))
        return out / len(docs) + 5e-6 * sum(w * w)

    best = loss(w)
    for f in range(5):
        for step in (-0.3, 0.3):
            moved = w.copy()
            moved[f] += step
            assert loss(moved) > best - 1e-4


def test_held_out_languages_and_toxic_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 1").repartition(8)
    told = o5.identify(docs, o5.fit(docs, P.path("piece_bpe_32k.model")))
    right = told.alias("t").join(docs.alias("d"), "doc_id").where(o5.held_out() & F.col("d.text").rlike(r"\p{L}")).agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.97, right
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi").repartition(8)
    scored = o8.score_documents(docs, o8.fit(docs, labels)).join(labels, "doc_id").where(o8.held_out())
    n = scored.groupBy("toxic").agg(F.avg((F.col("score") >= o8.THRESHOLD).cast("int")).alias("share")).collect()
    share = {r.toxic: r.share for r in n}
    assert share[1] > 0.8 and share[0] < 0.02, share
