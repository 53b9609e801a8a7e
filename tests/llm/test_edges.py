"""Repeated and null doc_ids, and columns named like results, in the operators that take each row by itself; archives that inflate a lot."""

import random
import zlib

import numpy as np
import public_tokenizers as P
from helpers import text
from tokenizers import Tokenizer

from cardlake.llm import op2_warc_normalise as o2
from cardlake.llm import op3_token_shards as o3
from cardlake.llm import op5_language_id as o5
from cardlake.llm import op7_sentencepiece as o7
from cardlake.llm import op8_toxicity as o8
from cardlake.llm import op10_fingerprints as o10
from cardlake.llm.shared import shared_folder

RNG = random.Random(17)
A, B = text(RNG, 30), text(RNG, 40)
ROWS = [(5, A), (5, A), (5, B), (None, A), (None, B), (None, None), (6, "")]
NAMES = ["lang", "score", "n_tokens", "text_hash", "__own_0", "lang_pred", "a.b"]


def docs(spark):
    return spark.createDataFrame([(i, t, "en", *("own" for _ in NAMES[1:])) for i, t in ROWS], ["doc_id", "text", *NAMES]).repartition(3)


def test_op3_keeps_every_row(spark):
    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = o3.read_shards(o3.write_shards(docs(spark), P.path("word_bpe_49k.json"), shared_folder(spark, "t"))).collect()
    crc = lambda t: zlib.crc32(np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert sorted(str((r.doc_id, r.ids_crc32)) for r in got) == sorted(str((i, crc(t))) for i, t in ROWS)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None, None, None, 5, 5, 5, 6]
    assert [r.start for r in by_start] == [sum(x.n_tokens for x in by_start[:k]) for k in range(len(by_start))]


def test_rows_by_themselves(spark):
    d = docs(spark)
    out = o7.encode_documents(d, P.path("piece_bpe_32k.model")).collect()
    assert len(out) == len(ROWS) and all(r.score == "own" and r["a.b"] == "own" for r in out)
    assert len({r.ids_sha256 for r in out}) == 3
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1)], "doc_id long, toxic int")
    scored = o8.score_documents(d, o8.fit(d, labels)).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 and r.lang_pred == "own" for r in scored)
    kept = o8.score_documents(d, o8.fit(d, labels), name="__toxicity").collect()
    assert all(r.score == "own" for r in kept)
    named = o5.identify(d, o5.fit(d, P.path("piece_bpe_32k.model"))).collect()
    assert sorted(str((r.doc_id, r.lang_pred)) for r in named) == sorted(str((i, "en" if t else "und")) for i, t in ROWS)


def test_op10_repeated_rows(spark):
    got = o10.fingerprints(docs(spark)).collect()
    assert len(got) == len(ROWS)
    assert len({r.fingerprint for r in got}) == 3  # of A, B, and nothing
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS)


def test_op2_inflates_in_bounds(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 30_000_000), (2, "u", "y"), (3, "u", "x" * 30_000_000)], "page_id long, url string, html string").withColumnRenamed("url", "url")
    got = sorted(tuple(r)[:2] + (r.record_type, r.refers_to) for r in o2.read_members(o2.normalised(o2.write_archives(pages, shared_folder(spark, "w")))).collect())
    assert got == [(1, 30_000_000, "response", None), (2, 1, "response", None), (3, 30_000_000, "revisit", 1)]


def test_op2_other_columns(spark):
    pages = spark.createDataFrame([(1, "u", "h", "own", 3), (2, "u", "h", "own", 4)], "page_id long, url string, html string, sha1 string, first int")
    got = sorted((r.page_id, r.record_type) for r in o2.read_members(o2.normalised(o2.write_archives(pages, shared_folder(spark, "w")))).collect())
    assert got == [(1, "response"), (2, "revisit")]
