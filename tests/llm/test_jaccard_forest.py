"""Operator 9: tries against brute force, and rows that are hard to keep apart."""

import random

import numpy as np
import pytest
from helpers import frame, text

from cardlake.llm import op9_jaccard_join as o9


def connected(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("size", [12, 150])
def test_walk_connects_what_a_trie_shares(size):
    """Two tries of sorted paths: leaves that share the floor's prefix and seem similar are connected, each from its longest match on."""
    rng = np.random.default_rng(size)
    seeds = rng.integers(0, 3, (4, o9.DEPTH))
    path = np.where(rng.random((2 * size, o9.DEPTH)) < 0.3, rng.integers(0, 3, (2 * size, o9.DEPTH)), seeds[rng.integers(0, 4, 2 * size)])
    sig = np.where(rng.random((2 * size, 144)) < 0.15, rng.integers(0, 99, (2 * size, 144)), rng.integers(0, 99, (6, 144))[rng.integers(0, 6, 2 * size)]).astype(np.uint16)
    for half in (slice(0, size), slice(size, None)):
        order = np.lexsort(path[half].T[::-1])
        path[half], sig[half] = path[half][order], sig[half][order]
    cut = np.array([0, size, 2 * size])
    for floor in (3, 4):
        label, first = o9.walk(path.astype(np.uint16), cut, sig, floor)
        same = lambda a, b: next((d for d in range(o9.DEPTH) if path[a, d] != path[b, d]), o9.DEPTH)  # noqa: B023, E731
        inside = [(a, b) for t in (range(size), range(size, 2 * size)) for a in t for b in t if a < b]
        pairs = [(a, b) for a, b in inside if same(a, b) >= floor and (sig[a] == sig[b]).mean() >= o9.SEEMS]
        assert label.tolist() == connected(2 * size, pairs)
        for a in range(2 * size):
            longest = max(same(*p) for p in inside if a in p)
            assert first[a] == (longest if longest >= floor else 0)
        assert {*first.tolist()} <= {0, *range(floor, o9.DEPTH + 1)} and len({*first.tolist()}) > 2


def test_the_floor_reaches_the_recall():
    d = o9.stop_depth()
    chance = lambda d: 1 - (1 - o9.SIMILARITY**d) ** o9.TREES
    assert chance(d) >= o9.RECALL > chance(d + 1) and o9.DEPTH > d
    assert o9.stop_depth(0.95) > d


def links(spark, rows):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in o9.near_duplicates(frame(spark, rows)).collect()), key=str)


def test_repeated_rows_and_ids(spark):
    rng = random.Random(5)
    a = text(rng, 80)
    near, other, lone = a + " tail", text(rng, 50), text(rng, 60)
    assert links(spark, [(1, a), (1, a), (2, near)]) == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]
    assert links(spark, [(1, a), (5, other), (2, near), (3, other)]) == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (5, 3, 1)]
    assert links(spark, [(1, a), (1, other), (2, near), (3, other)]) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    got = links(spark, [(None, a), (None, a), (7, near), (None, lone), (None, None), (9, "")])
    assert got == sorted([(None, 7, 2), (None, 7, 2), (7, 7, 2), (None, None, 0), (None, 9, 1), (9, 9, 1)], key=str)


def test_texts_of_equal_words_in_thue_morse_order_are_no_copies(spark):
    x, y = ["aa"], ["bb"]
    while len(x) < 4096:
        x, y = x + y, y + x
    got = {r.doc_id: r.copy_of for r in o9.near_duplicates(frame(spark, [(1, " ".join(x)), (2, " ".join(y)), (3, "\n".join(x))])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_first_rows(spark):
    rows = [(3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "a  b c d e f"), (4, "x")]
    got = sorted((str(r.doc_id), r.first) for r in o9.near_duplicates(frame(spark, rows)).collect())
    assert got == [("2", True), ("2", True), ("3", False), ("4", True), ("None", False)]


def test_a_large_group_of_near_copies_has_few_edges(spark, monkeypatch):
    """Each text is linked in a few trees, however many blocks its tries are dealt to, and the groups are those that whole tries give."""
    rng = random.Random(11)
    base, other = text(rng, 150).split(), text(rng, 150).split()
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(70)] + [(100 + i, " ".join([*other[: 150 - i], "cut"])) for i in range(0, 60, 3)]
    rows += [(200 + i, text(rng, 40)) for i in range(10)]
    whole, edges, components = links(spark, rows), [], o9.components
    assert {c for _, c, _ in whole} == {0, 100, *range(200, 210)} and {n for i, _, n in whole if i < 70} == {69}

    def counted(e):
        edges.append(e.distinct().count())
        return components(e)

    monkeypatch.setattr(o9, "components", counted)
    monkeypatch.setattr(o9, "PART", 10)
    assert links(spark, rows) == whole
    assert sum(edges[:-1]) <= 6 * 90  # the last are those of exact links


def test_walk_leaves_what_is_connected_already():
    rng = np.random.default_rng(3)
    path = np.sort(rng.integers(0, 2, (40, 1)), axis=0).repeat(o9.DEPTH, axis=1).astype(np.uint16)
    sig = rng.integers(0, 3, (3, 144))[rng.integers(0, 3, 40)].astype(np.uint16)
    cut, own = np.array([0, 25, 40]), rng.integers(0, 9, 40)
    label, _ = o9.walk(path, cut, sig, 4, own)
    inside = [(a, b) for lo, hi in ((0, 25), (25, 40)) for a in range(lo, hi) for b in range(a + 1, hi)]
    pairs = [(a, b) for a, b in inside if own[a] == own[b] or ((path[a] == path[b]).all() and (sig[a] == sig[b]).mean() >= o9.SEEMS)]
    assert label.tolist() == connected(40, pairs)
