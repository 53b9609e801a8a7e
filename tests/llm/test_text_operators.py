"""Each operator against brute force on small rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from helpers import documents, frame, text
from tokenizers import Tokenizer

from cardlake.llm import kernels as K
from cardlake.llm import op1_decontaminate as o1
from cardlake.llm import op2_warc_normalise as o2
from cardlake.llm import op3_token_shards as o3
from cardlake.llm import op4_suffix_dedup as o4
from cardlake.llm import op5_language_id as o5
from cardlake.llm import op6_substring_dedup as o6
from cardlake.llm import op7_sentencepiece as o7
from cardlake.llm import op8_toxicity as o8
from cardlake.llm import op9_jaccard_join as o9
from cardlake.llm import op10_fingerprints as o10
from cardlake.llm.components import components
from cardlake.llm.shared import shared_folder

ROWS = documents()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


def sha(x):
    return hashlib.sha256(x).hexdigest()


def repeats(items, t):
    """items: sorted (id, sequence) -> id: flags of removed elements."""
    seen, out = set(), {}
    for i, x in items:
        gone = [False] * len(x)
        for s in range(len(x) - t + 1):
            w = tuple(x[s : s + t])
            if w in seen:
                gone[s : s + t] = [True] * t
            seen.add(w)
        out[i] = gone
    return out


def test_op4(docs):
    items = [(i, (t or "").encode()) for i, t in sorted(ROWS)]
    gone = repeats(items, 100)
    got = {r.doc_id: r for r in o4.remove_repeats(docs).collect()}
    for i, x in items:
        g = gone[i]
        kept = bytes(b for b, y in zip(x, g) if not y)
        spans = sum(y and not (k and g[k - 1]) for k, y in enumerate(g))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept) == (len(x), sum(g), spans, sha(kept), kept.decode("utf-8", "ignore"))
        assert r.source == "src"


@pytest.mark.parametrize("group", [200_000, 2])
def test_op6(docs, group):
    items = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in sorted(ROWS)]
    gone = repeats(items, 20)
    got = {r.doc_id: r for r in o6.remove_repeated_words(docs, group=group).collect()}
    for i, x in items:
        kept = b" ".join(w for w, y in zip(x, gone[i]) if not y)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(x), sum(gone[i]), sha(kept))


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "q" + "abc" * 60), (1, "q" + "abc" * 60)]
    got = o4.remove_repeats(frame(spark, rows)).collect()
    assert len({(r.n_removed, r.kept_sha256) for r in got}) == 1


@pytest.mark.parametrize("op", [4, 6])
def test_null_and_repeated_ids_with_different_texts(spark, op):
    rng = random.Random(4)
    passage, other = text(rng, 60), text(rng, 60)
    lone = [text(rng, 50) for _ in range(3)]
    texts = [passage + " " + lone[0], passage + " " + lone[1], lone[2], other, text(rng, 5) + " " + other, passage, other[:200], None]
    rows = [(i, t) for i in (None, 3) for t in texts] + [(None, texts[0]), (3, texts[1]), (1, lone[0] + " " + other), (5, lone[1])]
    d = frame(spark, rows, 5)
    ties = {r.text: r.tie for r in d.selectExpr("text", "xxhash64(text) AS tie").collect()}
    split = (lambda t: list((t or "").encode())) if op == 4 else (lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]))
    gone = repeats([(r, split(r[1])) for r in order], 100 if op == 4 else 20)
    want = []
    for r in rows:
        left = [x for x, g in zip(split(r[1]), gone[r], strict=True) if not g]
        want.append((r[0], sum(gone[r]), sha(bytes(left) if op == 4 else b" ".join(left))))
    got = (o4.remove_repeats if op == 4 else o6.remove_repeated_words)(d).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_removed, r.kept_sha256)) for r in got)


def test_op7(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    c = o7.codec(P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in o7.encode_documents(docs, P.path("piece_bpe_32k.model"), ids=True).collect()}
    for i, t in ROWS:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == sha(np.array(ids, "<u4").tobytes()) and got[i].decoded_sha256 == sha(sp.decode(ids).encode())
        assert c.decode(np.array(ids, "<u4").tobytes()) == sp.decode(ids).encode()


def test_op7_checks_chunks_of_every_kind(monkeypatch):
    """A wrong encoding of any chunk is noticed: of a first word of a line, a line feed, marks alone."""
    c = o7.MergeCodec(P.path("piece_bpe_32k.model"))
    kinds = ["Word", "\n", o7.MARK, o7.MARK * 3, o7.MARK + "word", o7.MARK * 2 + "word", "é", "\x00", "日本"]
    assert len(c._encode_checked(kinds)) == len(kinds)
    real = c.encode_chunk
    for k in kinds:
        monkeypatch.setattr(c, "encode_chunk", lambda x, k=k: [*real(x), 5] if x == k else real(x))
        with pytest.raises(ValueError, match="otherwise"):
            c._encode_checked(kinds)


def test_long_agenda_equals_short_one():
    c = o7.codec(P.path("piece_bpe_32k.model"))
    for t in ["▁understanding", "▁größen", "▁a" + "na" * 20]:
        assert c._short(t) == c._long(t)


def test_op3(spark, docs):
    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for shard in (1 << 22, 500):
        got = {r.doc_id: r for r in o3.read_shards(o3.write_shards(docs, P.path("word_bpe_49k.json"), shared_folder(spark, "t"), shard)).collect()}
        start = 0
        for i, t in sorted(ROWS):
            ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
            assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)


def test_wavelet_matrix(tmp_path):
    x = np.random.default_rng(0).integers(0, 300, 40_000)
    uri = f"file://{tmp_path}/x.wm"
    o3.write_shard(uri, x, 9, np.arange(3), np.array([1, 2, len(x) - 3]))
    with o3.open_shard(uri) as shard:
        assert (shard.ids() == x).all() and [v.tolist() for v in shard.documents()] == [[0, 1, 2], [1, 2, len(x) - 3]]
        for w in (o3.WaveletMatrix.build(x, 9), shard.matrix):
            assert (w.ids() == x).all()
            for i in (0, 511, o3.STEP, o3.STEP + 1, 2 * o3.STEP, len(x) - 1):
                assert w.access(i) == x[i] and w.rank(int(x[i]), i) == (x[:i] == x[i]).sum()
            for token in (int(x[5]), 7, 299, 300):
                assert w.occurrences(token) == np.flatnonzero(x == token).tolist() and w.count(token) == (x == token).sum()


def test_one_question_reads_little_of_a_shard(tmp_path):
    x = np.random.default_rng(0).integers(0, 49_000, o3.SHARD)
    uri = f"file://{tmp_path}/x.wm"
    size = o3.write_shard(uri, x, 16, np.arange(1), np.array([len(x)]))
    for ask, part in ((lambda m: m.access(3_000_000) == x[3_000_000], 0.01), (lambda m: m.rank(77, 2_000_001) == (x[:2_000_001] == 77).sum(), 0.02), (lambda m: m.select(77, 5) == np.flatnonzero(x == 77)[5], 0.03)):
        with o3.open_shard(uri) as shard:
            assert ask(shard.matrix) and shard.read < part * size, shard.read / size


def test_op3_words_of_equal_hash(spark, monkeypatch):
    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    m = o3.IdMemory(lambda words: [np.array(tk.encode(w, add_special_tokens=False).ids, dtype=np.uint32) for w in words])
    x = "ab"
    for _ in range(11):
        x += x.translate(str.maketrans("ab", "ba"))
    texts = [f"one {x} two", f"one {x.translate(str.maketrans('ab', 'ba'))} two", "", "one"]
    for hashes in (K.span_hashes, lambda d, a, b: np.ones(len(a), np.uint64)):
        monkeypatch.setattr("cardlake.llm.kernels.span_hashes", hashes)
        m.forget()
        (data, offs), = list(o3.blocks(pa.array(texts)))
        for _ in range(2):
            ids, sizes = m.encode_block(data, offs)
            assert ids.tolist() == [i for t in texts for i in tk.encode(t, add_special_tokens=False).ids] and sizes.tolist() == [len(tk.encode(t, add_special_tokens=False).ids) for t in texts]


def test_op2(spark):
    rows = [(1, "http://a b\n", "<p>x</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>x</p>"), (5, "u", "é" * 100), (4, "u", "<p>x</p>"), (None, "u", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (1 << 26, 10):
        got = sorted(tuple(r)[:5] for r in o2.read_members(o2.normalised(o2.write_archives(pages, shared_folder(spark, "w"), size))).collect() if r.page_id is not None)
        d = lambda s: o2.digest(s.encode())
        x = (8, d("<p>x</p>"))
        assert sorted(map(str, got)) == sorted(map(str, [(1, *x, "response", None), (2, 0, d(""), "response", None), (3, 0, d(""), "revisit", 2), (4, *x, "revisit", 1), (4, *x, "revisit", 1), (5, 200, d("é" * 100), "response", None)]))


def test_op9(docs):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in ROWS}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    like = lambda a, b: words[a] == words[b] or (bool(sets[a] | sets[b]) and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]))
    links = {i: [j for j in sets if j != i and like(i, j)] for i in sets}

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(seen)

    for r in o9.near_duplicates(docs).collect():
        assert (r.class_id, r.n_links) == (reach(r.doc_id), len(links[r.doc_id]))


def test_op9_in_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    rows = [(n, " ".join([*base[:n], f"edit{n}", *base[n + 1 :]])) for n in range(0, 60)]
    whole = {tuple(r) for r in o9.near_duplicates(frame(spark, rows)).collect()}
    monkeypatch.setattr(o9, "PART", 7)
    assert {tuple(r) for r in o9.near_duplicates(frame(spark, rows)).collect()} == whole
    assert {r[4] for r in whole} == {59}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 20)] + [(30, 31), (40, 40)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(21)} | {(30, 30), (31, 30)}
    assert components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1 << 23, 0])
def test_op1(spark, docs, limit):
    rng = np.random.default_rng(3)
    item = [f"tok{i}" for i in rng.integers(0, 10_000, 40)]
    changed = [*item]
    changed[7], changed[25] = "other", "words"
    rows = [*ROWS, (900, "Before " + " ".join(item).upper() + " after"), (901, " ".join(changed)), (902, " ".join(item[:8])), (903, "one two THREE four five six")]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "a b"), (5, "one two three, four five six")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in o1.leaks(frame(spark, rows), bench, limit, min_item=5).collect()}
    assert set(got) == {(900, 1), (901, 1), (903, 5)}
    assert got[900, 1].share == 1.0 and got[901, 1].n_matched == 38


def test_op1_seeds_hit_every_pattern():
    """Of all patterns of any length that no mask fits into, the best matches - 4 x mismatches by the last places and matches so far: never 0 with 12 matches."""
    masks = [m for m in o1.MASKS if m.count("1") > 5]
    keep = max(map(len, masks)) - 1
    best = {("0" * keep, 0): 0}
    todo = list(best)
    while todo:
        last, matches = at = todo.pop()
        for bit, score in (("1", 1), ("0", -4)):
            new = last + bit
            if any(all(x == "0" or y == "1" for x, y in zip(m, new[-len(m) :], strict=True)) for m in masks):
                continue
            to, value = (new[1:], min(12, matches + (bit == "1"))), best[at] + score
            assert to[1] < 12 or value < 0, new
            if value > best.get(to, -60):
                best[to] = value
                todo.append(to)


def test_op1_verifies_every_stretch_within_the_limits():
    def leak(same):
        whole = len(same) < 15 and sum(same) * 5 >= len(same) * 4
        return whole or any(sum(same[a:b]) >= 12 and sum(same[a:b]) * 5 >= (b - a) * 4 for a in range(len(same)) for b in range(a + 12, len(same) + 1))

    rng = np.random.default_rng(8)
    patterns = [[i not in gone for i in range(15)] for gone in itertools.combinations(range(15), 3)]
    patterns += [(rng.random(n) < 0.78).tolist() for n in rng.integers(5, 60, 1500)]
    for same in patterns:
        found = o1.stretch(np.arange(len(same)), np.where(same, np.arange(len(same)), -1), 0)
        assert bool(found) == leak(same), same
        if found:
            a, n, matched = found
            assert matched == sum(same[a : a + n]) and matched * 5 >= n * 4 and (matched >= 12 or n == len(same) < 15)
    for n in range(5, o1.SEEDED):
        for gone in itertools.combinations(range(n), n // 5):
            same = ["0" if i in gone else "1" for i in range(n)]
            masks = [o1.MASKS[m] for m in o1.item_masks(n)]
            assert any(all(x == "0" or y == "1" for x, y in zip(m, same[i : i + len(m)], strict=True)) for m in masks for i in range(n - len(m) + 1)), same


def test_op1_is_the_same_by_both_ways(spark):
    """Null and repeated doc_ids, repeated items, documents with and without leaks."""
    rng = random.Random(11)
    items = [text(rng, n) for n in (6, 12, 30, 60)]
    rows = [(None, "x " + items[0]), (None, items[2] + " y"), (1, items[1]), (1, items[3]), (1, items[1]), (2, text(rng, 40)), (None, None), (3, "")]
    bench = spark.createDataFrame([(1, items[0]), (2, items[1]), (2, items[2]), (3, items[3]), (3, items[3]), (None, items[1])], "item_id long, text string")
    small, large = (sorted(map(str, o1.leaks(frame(spark, rows), bench, limit).collect())) for limit in (1 << 23, 0))
    assert small == large and len(small) == 1 + 1 + 2 * 1 + 2


@pytest.mark.parametrize("limit", [1 << 23, 0])
def test_op1_finds_items_of_5_to_15_tokens_with_substitutions(spark, limit):
    rng = np.random.default_rng(6)
    items, rows = [], []
    for n in [5, 7, 9, 10, 11, 12, 13, 14, 15] * 8:
        item = [f"t{i}" for i in rng.integers(0, 100_000, n)]
        copy = [*item]
        for i in rng.choice(n, n // 5, replace=False):
            copy[i] = "other"
        items.append((len(items), " ".join(item)))
        rows.append((len(rows), " ".join(copy)))
    got = {(r.doc_id, r.item_id): r.n_matched for r in o1.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), limit).collect()}
    assert got == {(i, i): len(t.split()) - len(t.split()) // 5 for i, t in items}


@pytest.mark.parametrize("limit", [1 << 23, 0])
def test_op1_finds_short_items_with_substitutions(spark, limit):
    rng = np.random.default_rng(5)
    items, rows = [], []
    for n, k in [(14, 2), (15, 2), (16, 3), (17, 3), (18, 3), (20, 4), (25, 5)] * 12:
        item = [f"t{i}" for i in rng.integers(0, 100_000, n)]
        copy = [*item]
        for i in rng.choice(n, k, replace=False):
            copy[i] = "other"
        if o1.stretch(np.array(item), np.array(copy), 0):
            items.append((len(items), " ".join(item)))
            rows.append((len(rows), " ".join(copy)))
    got = {(r.doc_id, r.item_id) for r in o1.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), limit).collect()}
    assert len(items) > 40 and got == {(i, i) for i in range(len(items))}


def test_op8(spark):
    clean, bad = "a quiet walk. you sit! by the river", "a quiet walk. you {}! by the river"
    rows = [(i, bad.format(["clot", "cloten", "clotish"][i % 3]) if i % 2 else clean) for i in range(300)] + [(500, None), (501, ""), (502, "fine.\n\nand a clot here. fine")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(7, None)], "doc_id long, toxic int")
    d = frame(spark, rows)
    model = o8.fit(d, labels)
    got = {r.doc_id: r for r in o8.score_documents(d, model, locate=True).collect()}
    assert all((got[i].score >= o8.THRESHOLD) == bool(i % 2) for i in range(300))
    assert got[500].score == got[501].score == 0 and got[502].offending == [3]
    assert {r.score for r in o8.score_documents(d, o8.fit(d, labels.where("toxic = 0"))).collect()} == {0.0}


def test_op8_learns_from_a_bounded_sample(spark):
    """One row of an id that many share, whatever their order; no more bytes of a class than asked for, large documents last."""
    rows = [(i, f"text {i} " + "x" * 90) for i in range(80)] + [(81, f"copy {k}") for k in range(500)] + [(85, "y" * 5000), (83, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(86)] + [(83, None)], "doc_id long, toxic int")

    def picked(order, n, size):
        found = o8._sampled(frame(spark, rows[::order]).repartition(n), labels, 2000, size).collect()
        return sorted((r.doc_id, r.text or "", r.toxic) for r in found)

    known = {r[0] for r in labels.where(~o8.held_out()).select("doc_id").collect()}
    whole = picked(1, 3, 1 << 20)
    assert {r[0] for r in whole} == known & {r[0] for r in rows} and len({r[0] for r in whole}) == len(whole)
    assert picked(-1, 5, 1 << 20) == whole and {81, 85} < known
    few = picked(1, 2, 1600)
    assert picked(-1, 4, 1600) == few and set(few) < set(whole) and all(len(t) <= 100 for _, t, _ in few)
    assert all(1400 < sum(len(t) for _, t, y in few if y == k) <= 1600 for k in (0, 1))
    assert not len(o8.fit(frame(spark, rows), labels, sample_bytes=0).features)


def test_op5(spark):
    rows = [(i, " ".join(x for x in (("the house and the garden", "en"), ("das haus und der garten", "de"))[i % 2][0].split()), ("en", "de")[i % 2]) for i in range(60)] + [(90, None, "en"), (91, "12 34 !?", "de"), (92, "Und Das", None), (93, "z" * 100, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    path = P.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in o5.identify(d, o5.fit(d, path)).collect()}
    assert all(got[i].lang_pred == ("en", "de")[i % 2] and 0 <= got[i].score <= 1 for i in range(60))
    assert got[90].lang_pred == got[91].lang_pred == "und" and got[92].lang_pred == "de" and got[93].lang_pred in ("de", "en")
    assert {r.lang_pred for r in o5.identify(d, o5.fit(d.limit(0), path)).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    v = o5.Pieces(P.path("piece_bpe_32k.model"))
    p = np.random.default_rng(0).random((v.n + 2, 1))
    p[-1] = 0
    (_, chars), = o5._by_length(["▁hat"])
    lattice = v.lattice(chars)

    def total(at):
        return 1.0 if at == 4 else sum(p[w[0], 0] * total(b) for a, b, w in lattice if a == at and w[0] >= 0)

    assert abs(o5.forward(lattice, 4, 1, p)[4, 0, 0] - total(0)) < 1e-9


def test_long_words_are_scored_whole():
    v = o5.Pieces(P.path("piece_bpe_32k.model"))
    p = np.random.default_rng(0).random((v.n + 2, 2)) / 50
    p[-1] = 0
    for w in ("▁hat", "▁" + "understanding" * 2, "▁日本語ab"):
        (_, chars), = o5._by_length([w])
        whole = np.log(o5.forward(v.lattice(chars), chars.shape[1], 1, p)[-1][0])
        assert np.allclose(whole, o5.long_word(v, w, p))
    assert v.longest > 8 and np.isfinite(o5.long_word(v, "▁" + "größe" * 5000, p)).all()


def test_op10(docs):
    got = {r.doc_id: r for r in o10.fingerprints(docs).collect()}
    order = sorted(ROWS, key=lambda r: -r[0])
    sets = lambda t: set(o10.digests(pa.array([t]))[0].tolist())
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    prints = {}
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        a, b = a or "", b or ""
        k = len(a) // 3
        e = a[: len(a) - k] + b[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(a), sha(e.encode()))
        assert abs(r.near_edited - like(sets(a), sets(e))) < 1e-9 and abs(r.near_next - like(sets(a), sets(b))) < 1e-9
        assert prints.setdefault(a, r.fingerprint) == r.fingerprint


def test_printed_fingerprints_tell_what_differs():
    rng = random.Random(9)
    base = [text(rng, 8) + "." for _ in range(60)]
    versions = [" ".join([*base[:k], *(text(rng, 8) + "." for _ in range(k % 5)), *base[k + k % 3 :]]) for k in range(40)] + ["", "x"]
    prints = [o10.sketched(*o10.digests(pa.array([v]))).texts(np.array([len(o10.digests(pa.array([v]))[0])]))[0] for v in versions]
    sets = [set(o10.digests(pa.array([v]))[0].tolist()) for v in versions]
    pairs = list(itertools.product(range(len(versions)), repeat=2))
    mine, other, like, clear = o10.differences([prints[a] for a, _ in pairs], [prints[b] for _, b in pairs])
    for i, (a, b) in enumerate(pairs):
        if clear[i]:
            assert (set(mine[i]), set(other[i])) == (sets[a] - sets[b], sets[b] - sets[a])
            assert abs(like[i] - (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0)) < 1e-12
    few = np.array([len(sets[a] ^ sets[b]) <= 12 for a, b in pairs])
    assert clear[few].mean() > 0.9 and few.sum() > 100


def test_lone_and_empty_tables(spark):
    one = o10.fingerprints(frame(spark, [(1, "abc def ghi")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    none = frame(spark, ROWS).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert o1.leaks(none, bench).count() == o4.remove_repeats(none).count() == o6.remove_repeated_words(none).count() == o9.near_duplicates(none).count() == 0
    assert o7.encode_documents(none, P.path("piece_bpe_32k.model")).count() == o8.score_documents(none, o8.fit(none, labels)).count() == o10.fingerprints(none).count() == 0
    assert o3.read_shards(o3.write_shards(none, P.path("word_bpe_49k.json"), shared_folder(spark, "t"))).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert o2.read_members(o2.normalised(o2.write_archives(pages, shared_folder(spark, "w")))).count() == 0


def test_null_doc_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, toxic int")
    assert o4.remove_repeats(d).count() == o6.remove_repeated_words(d).count() == o9.near_duplicates(d).count() == o10.fingerprints(d).count() == 3
    assert o3.read_shards(o3.write_shards(d, P.path("word_bpe_49k.json"), shared_folder(spark, "t"))).count() == 3
    assert o8.score_documents(d, o8.fit(d, labels)).count() == o7.encode_documents(d, P.path("piece_bpe_32k.model")).count() == 3
