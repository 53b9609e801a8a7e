"""Operators 4 and 6: the sort, the trees, and rows that are hard to keep apart."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from helpers import frame, text

from cardlake.llm import kernels as K
from cardlake.llm import op4_suffix_dedup as o4
from cardlake.llm import op6_substring_dedup as o6


def test_radix_groups_order_and_keep_equal_suffixes():
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab") for _ in range(400)) + b"abab" * 20
    for depth in (3, 8, 11, 20):
        start = np.array(rng.sample(range(len(data) - depth), 300))
        left, group = o4.radix_groups(np.frombuffer(data, np.uint8), start, depth)
        content = [data[start[i] : start[i] + depth] for i in range(len(start))]
        assert sorted(left.tolist()) == [i for i in range(len(start)) if content.count(content[i]) > 1]
        assert [content[i] for i in left] == sorted(content[i] for i in left)
        assert [a == b for a, b in itertools.pairwise(group)] == [content[a] == content[b] for a, b in itertools.pairwise(left)]


def naive_tree(rows, depth=0):
    """(depth, leaves) of the internal nodes of the trie of equal-length rows, single chains left out."""
    out = set()
    for d in range(1 if depth == 0 else depth, len(rows[0]) + 1):
        for prefix in {r[:d] for r in rows}:
            leaves = [i for i, r in enumerate(rows) if r[:d] == prefix]
            nexts = {rows[i][d] for i in leaves} if d < len(rows[0]) else set()
            if len(leaves) > 1 and len(nexts) != 1:
                out.add((d, leaves[0], leaves[-1] + 1))
    return out


def test_tree_has_the_nodes_of_a_naive_one():
    rng = random.Random(3)
    rows = sorted(tuple(rng.choice((5, 6)) for _ in range(6)) for _ in range(60))
    deep, span = o6.tree(np.array(rows, dtype=np.uint64))
    got = {(d, a, b) for d, (a, b) in zip(deep.tolist(), span.tolist()) if d}
    assert got == naive_tree(rows)
    assert {(0, 0, 60)} == {(d, a, b) for d, (a, b) in zip(deep.tolist(), span.tolist()) if not d}
    two = np.array([*rows, *rows[:7]], dtype=np.uint64)
    deep, span = o6.tree(two, np.array([0, 60, 67]))
    assert {(d, a, b) for d, (a, b) in zip(deep.tolist(), span.tolist()) if d} == got | {(d, a + 60, b + 60) for d, a, b in naive_tree(rows[:7])}
    assert len(o6.tree(np.array(rows[:1], dtype=np.uint64))[0]) == 0


def want(rows, split, t):
    seen, out = set(), []
    for i, x in sorted((i, split(x)) for i, x in rows):
        gone = [False] * len(x)
        for s in range(len(x) - t + 1):
            w = tuple(x[s : s + t])
            if w in seen:
                gone[s : s + t] = [True] * t
            seen.add(w)
        out.append((i, sum(gone)))
    return out


def edited(seed, n=60):
    """Texts that share a passage edited at every place, and so have many suffixes with long common prefixes."""
    rng = random.Random(seed)
    passage = text(rng, 60).split()
    rows = []
    for i in range(n):
        words = [*passage]
        words[rng.randrange(60)] = f"edit{i % 7}"
        rows.append((i, " ".join([text(rng, 4), *words[rng.randrange(20) :], text(rng, 4)])))
    return rows


@pytest.mark.parametrize("group", [100_000, 3])
def test_edited_passages_with_small_and_large_groups(spark, group):
    rows = edited(1)
    by_bytes, by_words = (lambda x: list(x.encode())), (lambda x: re.findall(r"[^\x20\x09-\x0D]+", x))
    d = frame(spark, rows, 5)
    assert sorted((r.doc_id, r.n_removed) for r in o4.remove_repeats(d, group=group).collect()) == want(rows, by_bytes, 100)
    assert sorted((r.doc_id, r.n_removed) for r in o6.remove_repeated_words(d, group=group).collect()) == want(rows, by_words, 20)


def test_columns_named_like_inner_ones(spark):
    names = ["doc", "tie", "marks", "__key", "__tie", "__runs", "core", "score", "n_bytes", "a.b"]
    p = "passage " * 30
    d = spark.createDataFrame([(i, p, *(f"{n}{i}" for n in names)) for i in (1, 2)], ["doc_id", "text", *names])
    for out, new in ((o4.remove_repeats(d), "n_bytes"), (o6.remove_repeated_words(d), None)):
        got = {r.doc_id: r for r in out.collect()}
        for i in (1, 2):
            assert all(got[i][n] == f"{n}{i}" for n in names if n != new)
        assert got[1].n_removed < got[2].n_removed


def thue_morse(a, b, n):
    out = [a]
    other = [b]
    while len(out) < n:
        out, other = out + other, other + out
    return out, other


@pytest.mark.parametrize("op", [4, 6])
def test_thue_morse_sequences_are_not_copies(spark, op):
    x, y = thue_morse("a", "b", 4096)
    join = "".join if op == 4 else " ".join
    rows = [(1, join(x)), (2, join(y))]
    if op == 4:
        split, t, run = (lambda s: list(s.encode())), 100, o4.remove_repeats
    else:
        split, t, run = str.split, 20, o6.remove_repeated_words
    assert sorted((r.doc_id, r.n_removed) for r in run(frame(spark, rows)).collect()) == want(rows, split, t)


def test_hashes_tell_thue_morse_sequences_apart():
    x, y = (np.array(v, dtype=np.uint8) for v in thue_morse(97, 98, 4096))
    for n in (1, 2, 64, 1024, 2048, 4096):
        h = [K.Hashes(v).spans(np.array([0]), np.array([n]))[0] for v in (x, y, x.astype(np.uint64), y.astype(np.uint64))]
        assert len({*map(int, h)}) == 4
    data = np.concatenate([x, y])
    assert K.Hashes(data).grams(24)[7] == K.Hashes(data[7:]).spans(np.array([0]), np.array([24]))[0]
    assert hashlib.sha256(x.tobytes()).digest() != hashlib.sha256(y.tobytes()).digest()
