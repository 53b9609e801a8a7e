"""The pipeline on planted tables, each stage's rows against brute force."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import sentencepiece
from helpers import WORDS, text

import corpus_pipeline as c

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, `__of_x` int"


def planted():
    """doc_id -> text of clean, toxic, copied, edited, leaking and repetitive documents; labels; benchmark items."""
    rng = random.Random(21)
    docs, labels = [], []
    for i in range(240):
        some = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))  # noqa: B023, E731
        docs.append((i, f"{some(40)}. you {['clot', 'cloten', 'clotish'][i % 2] if i % 3 == 0 else 'sit'}! {some(20)}"))
        labels.append((i, int(i % 3 == 0)))
    a, passage = text(rng, 90), text(rng, 40)
    items = [text(rng, n) for n in (25, 60)]
    docs += [(300, a), (301, a), (302, a + " tail"), (302, a), (303, text(rng, 30) + " " + passage), (304, passage + " " + text(rng, 30)), (305, text(rng, 9) + " " + items[0] + " " + text(rng, 9))]
    docs += [(306, items[1].replace("a,b", "A ; b")), (307, None), (308, ""), (None, text(rng, 30)), (None, text(rng, 35)), (309, "you clot!"), (303, text(rng, 33)), (None, items[0] + " end")]
    return docs, labels, items


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(docs, items, ties):
    """Rows (doc_id, text) after each stage but the last."""
    key = lambda r: (r[0] is None, r[0] or 0, ties[r[1]])
    docs = [r for r in docs if not re.search("you (clot|cloten|clotish)!", r[1] or "")]
    yield docs
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t in docs]
    like = lambda a, b: words(docs[a][1]) == words(docs[b][1]) or (sets[a] | sets[b] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]))
    label = list(range(len(docs)))
    for _ in range(3):
        for a in range(len(docs)):
            for b in range(len(docs)):
                if like(a, b):
                    label[a] = label[b] = min(label[a], label[b])
    docs = [min((r for r, x in zip(docs, label) if x == of), key=key) for of in sorted(set(label))]
    yield docs
    seen, kept = set(), []
    for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]])):
        x = (t or "").encode()
        gone = [False] * len(x)
        for k in range(len(x) - 99):
            if x[k : k + 100] in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(x[k : k + 100])
        kept.append((i, bytes(b for b, g in zip(x, gone) if not g).decode("utf-8", "ignore")))
    docs = kept
    yield docs
    plain = lambda t: re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", (t or "").lower()).strip()
    yield [r for r in docs if not any(plain(x) in plain(r[1]) for x in items)]


def test_stages_on_planted_documents(spark, tmp_path):
    docs, labels, items = planted()
    rows = [(i, t, "en", "s", 5, 5.0, 9) for i, t in docs]
    d = spark.createDataFrame(rows, COLUMNS)
    ties = {r.text: r.tie for r in d.selectExpr("text", "xxhash64(text) AS tie").collect()}
    d.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), want in zip(c.STAGES[:-1], brute(docs, items, ties)):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now, before = spark.read.parquet(f"{tmp_path}/{name}"), now
        got = now.collect()
        assert now.columns == before.columns and {(r.score, r["__of_x"], r.source) for r in got} == {(5.0, 9, "s")}, name
        assert sorted(map(str, ((r.doc_id, r.text or "") for r in got))) == sorted(map(str, ((i, t or "") for i, t in want))), name
    assert all(r.n_chars == len(r.text) for r in got)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    last = []
    for r in got:
        ids = sp.encode(r.text, add_bos=True, add_eos=True)
        last.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, c.run(spark, str(tmp_path)).collect()))) == sorted(map(str, last))


def test_an_empty_table_stays_empty(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = c.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
