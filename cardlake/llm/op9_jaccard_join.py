"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Shingles are five consecutive words (``[^\\x20\\x09-\\x0D]+``, unchanged); a text of one to four words is one
shingle. Two texts are linked if the Jaccard similarity of their shingle sets is 0.8 or more.

1. Texts of equal words (by a 128-bit BLAKE2 digest) form a class; only one of each class goes on.
2. Each has TREES labels of DEPTH minhashes: paths of a forest of prefix tries. Paths that share the shortest prefix that is
   used are dealt to a task and sorted; neighbours' common prefixes are the trie.
3. A trie is walked from the longest matched prefixes up. At each of its nodes the leaves of different children are compared by their
   whole signatures, and those that seem similar are connected. Prefixes are shortened only where something is left to be connected, and
   no further than ``stop_depth``: there the chance that a pair of similarity 0.8 shares a prefix in some tree reaches the target recall.
   A few trees go first, their tries of many leaves in blocks; then only leaves that aren't connected by those are compared, in pairs of blocks
   where they are many, and only edges between groups are given. What is connected in any tree is one candidate group.
4. Texts are sent once to their group and all pairs there are counted exactly as products of incidence matrices, in blocks:
   a text's links are counted, not emitted, so a group of copies costs rows in proportion to its size.

Texts without words are copies of each other and similar to nothing else. Nulls count as empty. Every row is a document: rows that repeat a
doc_id, or have none, are told apart by their texts, and equal rows are copies. Of ids a null one counts as the largest. Other columns
are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .shared import partitions, table

WORDS = 5
SIMILARITY = 0.8
TREES = 24
DEPTH = 6
RECALL = 0.99999
#: Bytes of a label.
LABEL = 2
#: A signature of 144 hashes is off by 0.033 (one sigma) at 0.8; pairs that seem less similar than this are not candidates.
SEEMS = 0.64
#: Members of a trie or group that one task compares.
PART = 1000
#: Trees whose tries are walked first, in blocks.
FIRST = 4
_rng = np.random.default_rng(9)
FACTORS = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def stop_depth(similarity: float = SIMILARITY, target: float = RECALL) -> int:
    """The longest prefix at which the forest finds a pair of this similarity with the target's chance."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - similarity**depth) ** TREES < target:
        depth -= 1
    return depth


def shingles(column: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the index of each row's first."""
    data, offs = K.text_bytes(column)
    start, end, first = K.word_spans(data, offs, K.SPACE)
    words = K.span_hashes(data, start, end)
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    cut = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(cut[-1]), dtype=np.uint64)
    a = 0
    while a < len(n):  # rows in blocks
        b = max(a + 1, int(np.searchsorted(first, first[a] + K.BLOCK, side="right")) - 1)
        h = K.Hashes(words[first[a] : first[b]])
        at, row = K.ranges(first[a:b] - first[a], count[a:b]), np.repeat(np.arange(a, b), count[a:b])
        out[cut[a] : cut[b]] = h.spans(at, at + np.minimum(n[row], k))
        a = b
    return out, cut


def word_digest(text: str | None) -> bytes:
    """Equal for equal words (bytes.split parts at the very bytes that separate words)."""
    return hashlib.blake2b(b" ".join((text or "").encode().split()), digest_size=16).digest()


def signatures(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The 128 minhashes (32 bits each) of each row."""
    out = np.zeros((len(cut) - 1, len(FACTORS)), dtype=np.uint32)
    full = np.flatnonzero(np.diff(cut))
    a = 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(cut[full], cut[full[a]] + (1 << 15), side="right")) - 1)
        rows = full[a:b]
        base = cut[rows[0]]
        block, at = x[base : cut[rows[-1] + 1]], cut[rows] - base
        for i, f in enumerate(FACTORS):
            out[rows, i] = np.minimum.reduceat((block * f) >> np.uint64(32), at)
        a = b
    return out


SIGNED = "doc long, tie long, c1 long, c2 long, sig binary, salt int"


def signed_docs(docs: DataFrame, salts: int) -> DataFrame:
    """docs: doc, tie, text. doc, tie, the digest of the words, the labels of all trees (none for texts without words), and one of some salts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in K.small(batches):
            x, cut = shingles(b.column("text"))
            sig = np.ascontiguousarray((signatures(x, cut) & 0xFFFF).astype(">u2")).tobytes()
            n, has = LABEL * len(FACTORS), (np.diff(cut) > 0).tolist()
            digests = np.frombuffer(b"".join(map(word_digest, b.column("text").to_pylist())), dtype=np.int64).reshape(-1, 2)
            labels = pa.array([sig[i * n : (i + 1) * n] if x else None for i, x in enumerate(has)], pa.binary())
            yield pa.record_batch(
                [
                    b.column("doc"),
                    b.column("tie"),
                    np.ascontiguousarray(digests[:, 0]),
                    np.ascontiguousarray(digests[:, 1]),
                    labels,
                    ((seen + np.arange(b.num_rows)) % salts).astype(np.int32),
                ],
                names=[c.split()[0] for c in SIGNED.split(", ")],
            )
            seen += b.num_rows

    return docs.mapInArrow(scan, SIGNED)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least connected index of each of n nodes."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _in_blocks(members: DataFrame, key: str, part: int) -> DataFrame:
    """Members of more than part are hashed to blocks, and each pair of blocks becomes a task's key (key, i, j); block tells a member's own."""
    blocks = F.ceil(F.col("n") / F.lit(part)).cast("int")
    return _paired(members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")), blocks)


def _paired(members: DataFrame, others: Column) -> DataFrame:
    """Each member once for each of the first so many blocks that its own is compared with."""
    rows = members.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")


def walk(path: np.ndarray, cut: np.ndarray, sig: np.ndarray, floor: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Walks tries of sorted paths (a row of labels each; cut: where each trie begins, and the end) from their longest common prefixes up.

    Leaves of a trie with the same own are connected already.

    Returns for each leaf the least one that it is connected with, and the length of the prefix at which it was first compared (0: never)."""
    n, depth = path.shape
    label, first_at = np.arange(n), np.zeros(n, np.int64)
    if own is not None:
        trie = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        order = np.lexsort((own, trie))
        start = np.flatnonzero(np.concatenate([[True], (own[order][1:] != own[order][:-1]) | (trie[order][1:] != trie[order][:-1])]))
        label[order] = np.repeat(order[start], np.diff(np.append(start, n)))
    differ = path[1:] != path[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    common[cut[1:-1] - 1] = -1

    def like(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (sig[a] == sig[b]).mean(axis=-1) >= SEEMS

    for d in range(depth, floor - 1, -1):
        edge = np.flatnonzero(np.concatenate([[True], common < d, [True]]))
        first, end = edge[:-1], edge[1:]
        before = lambda x: np.concatenate([[0], np.cumsum(x)])
        here, mixed = before(common == d), before(label[1:] != label[:-1])
        # nodes that begin to be shared at this depth, and whose leaves aren't all connected
        ok = (here[end - 1] > here[first]) & (mixed[end - 1] > mixed[first])
        first, size = first[ok], (end - first)[ok]
        child = np.arange(n) if d == depth else np.concatenate([[0], np.cumsum(common <= d)])
        fresh = np.zeros(n, dtype=bool)
        fresh[K.ranges(first, size)] = True
        first_at[fresh & (first_at == 0)] = d
        left, right = [np.arange(n)], [label]
        for m in np.unique(size[size <= 64]).tolist():  # all nodes of a size at once
            i, j = np.triu_indices(m, 1)
            at = first[size == m]
            step = max(1, (1 << 20) // len(i))
            for s in range(0, len(at), step):
                a, b = (at[s : s + step, None] + i).ravel(), (at[s : s + step, None] + j).ravel()
                new = (child[a] != child[b]) & (label[a] != label[b])
                a, b = a[new], b[new]
                ok = like(a, b)
                left.append(a[ok])
                right.append(b[ok])
        label = _labels(n, np.concatenate(left), np.concatenate(right))
        for lo, m in zip(first[size > 64].tolist(), size[size > 64].tolist(), strict=True):
            for x in range(lo, lo + m, 256):
                for y in range(x, lo + m, 256):
                    a, b = np.arange(x, min(x + 256, lo + m)), np.arange(y, min(y + 256, lo + m))
                    new = (child[a][:, None] != child[b]) & (label[a][:, None] != label[b])
                    if new.any():
                        u, v = np.nonzero(new & like(a[:, None], b[None]))
                        mine = label[lo : lo + m]
                        low = mine.min()  # labels of a trie are places in it
                        joined = _labels(
                            m + int(lo - low),
                            np.concatenate([a[u] - low, np.arange(lo, lo + m) - low]),
                            np.concatenate([b[v] - low, mine - low]),
                        )
                        label[lo : lo + m] = joined[lo - low :] + low
    return label, first_at


def _keys(reps: DataFrame, first: int, end: int) -> DataFrame:
    """reps in the tries of trees first to end: node, own, tree, key (of the trie)."""
    rows = reps.where(F.col("sig").isNotNull()).select("node", "own", "sig", F.explode(F.sequence(F.lit(first), F.lit(end - 1))).alias("tree"))
    key = F.xxhash64("tree", F.col("sig").substr(LABEL * DEPTH * F.col("tree") + 1, F.lit(LABEL * stop_depth())))
    return rows.select("node", "own", "tree", key.alias("key"))


def _connected(dealt: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """(a, b): values of own that are connected within one trie's part. dealt: node, own, tree, key, i, j."""
    floor = stop_depth()
    rows = dealt.join(reps.select("node", "sig"), "node")
    rows = rows.withColumn("path", F.col("sig").substr(LABEL * DEPTH * F.col("tree") + 1, F.lit(LABEL * DEPTH)))
    rows = rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "path", "node")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = lambda t, c: K.text_bytes(t.column(c))[0].view(">u2").astype(np.uint16).reshape(t.num_rows, -1)
        for t, cut in K.grouped(batches, ["key", "i", "j"]):
            own = t.column("own").to_numpy()
            label, _ = walk(labels(t, "path"), cut, labels(t, "sig"), floor, own)
            far = np.flatnonzero(own[label] != own)
            if len(far):
                pairs = np.unique(np.stack([own[label[far]], own[far]]), axis=1)
                yield pa.record_batch([pairs[0], pairs[1]], names=["a", "b"])

    return rows.select("key", "i", "j", "path", "node", "own", "sig").mapInArrow(scan, "a long, b long")


def first_edges(reps: DataFrame, n: int) -> DataFrame:
    """(a, b): a links b's candidate group, within one block of at most about PART leaves of a trie of the first trees. reps: node, own, sig."""
    keys = _keys(reps, 0, FIRST)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    block = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / F.lit(PART))).cast("int")
    dealt = keys.join(shared, "key").withColumn("i", block).withColumn("j", F.col("i"))
    return _connected(dealt, reps, n)


def other_edges(reps: DataFrame, n: int) -> DataFrame:
    """(a, b): values of own that any trie connects beyond ``first_edges``. reps: node, own (the group that those found), sig.

    Tries whose leaves are one group are done. In a trie of more than PART leaves the leaves of its largest group are only compared with
    the others, not with each other: rows grow with the product of both, not with the square of the trie."""
    keys = _keys(reps, 0, TREES)
    count = F.count(F.lit(1))
    shared = keys.groupBy("key").agg(count.alias("n"), F.min("tree").alias("tree"), F.min("own").alias("least"), F.max("own").alias("most"))
    shared = shared.where((F.col("least") != F.col("most")) & ((F.col("tree") >= FIRST) | (F.col("n") > PART))).select("key", "n")
    wide = keys.join(shared.where(F.col("n") > PART), "key").groupBy("key", "own").agg(count.alias("k"))
    wide = wide.groupBy("key").agg(F.max_by("own", F.struct("k", "own")).alias("main"), F.max("k").alias("k"))
    rows = keys.join(shared, "key").join(wide, "key", "left")
    k, hashed, blocks = F.coalesce("k", F.lit(0)), F.xxhash64("node"), lambda x: F.ceil(x / F.lit(PART)).cast("int")
    rest, main = blocks(F.col("n") - k), blocks(k)
    inside = F.coalesce(F.col("own") == F.col("main"), F.lit(False))
    rows = rows.withColumn("block", F.when(inside, rest + F.pmod(hashed, main)).otherwise(F.pmod(hashed, rest)).cast("int"))
    return _connected(_paired(rows, F.when(inside, rest).otherwise(rest + main)), reps, n)


def candidates(reps: DataFrame, n: int) -> DataFrame:
    """(node, label): nodes of groups of texts that seem similar, and the least node of each's group. reps: node, sig.

    The first trees connect most of what is similar, so that the edges of the others are few: those between groups."""
    near = components(first_edges(reps.withColumn("own", F.col("node")), n))
    known = table(reps.join(near, "node", "left").select("node", F.coalesce("label", "node").alias("own"), F.col("label").isNotNull().alias("found"), "sig"), "known")
    far = components(other_edges(known, n)).select(F.col("node").alias("at"), F.col("label").alias("to"))
    groups = known.join(far, F.col("own") == F.col("at"), "left").where(F.col("found") | F.col("to").isNotNull())
    return groups.select("node", F.coalesce("to", "own").alias("label"))


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, exactly, as products of incidence matrices."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[which] > 1
    which, owner = which[keep], owner[keep]
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    new = np.ones(len(which), dtype=bool)
    new[1:] = which[1:] != which[:-1]
    column = np.cumsum(new) - 1
    out = np.zeros((n, n), dtype=np.float32)
    width = max(64, (1 << 23) // max(n, 1))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((n, width), dtype=np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out.astype(np.int64)


def exact_links(groups: DataFrame, n: int) -> DataFrame:
    """(node, links, to): a member's linked documents in this pair of blocks, and the least one that it is connected with there.

    groups: node, copies (documents of its class), text, group, n (members)."""
    dealt = _in_blocks(groups, "group", PART).repartition(n, "group", "i", "j").sortWithinPartitions("group", "i", "j", "node")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in K.grouped(batches, ["group", "i", "j"]):
            node, copies, block = (t.column(c).to_numpy() for c in ("node", "copies", "block"))
            two = (t.column("i").to_numpy() != t.column("j").to_numpy())[cut[:-1]]
            x, at = shingles(t.column("text"))
            links, to = np.zeros(len(node), np.int64), node.copy()
            for g in range(len(cut) - 1):
                lo, hi = int(cut[g]), int(cut[g + 1])
                if hi - lo < 2:
                    continue
                sets = [np.unique(x[at[r] : at[r + 1]]) for r in range(lo, hi)]
                size = np.array([len(s) for s in sets])
                both = _shared_counts(sets)
                like = both * 5 >= (size[:, None] + size[None] - both) * 4
                np.fill_diagonal(like, False)
                a, b = np.nonzero(like)
                to[lo:hi] = node[lo + _labels(hi - lo, a, b)]
                counted = like & (block[lo:hi, None] != block[None, lo:hi]) if two[g] else like
                links[lo:hi] = counted @ copies[lo:hi]
            yield pa.record_batch([node, links, to], names=["node", "links", "to"])

    return dealt.select("group", "i", "j", "block", "node", "copies", "text").mapInArrow(scan, "node long, links long, to long")


def _first(doc: str, tie: str, *more: str) -> Column:
    """Compares as documents do: by doc_id, a null one last, then by the text's hash."""
    return F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("doc"), F.col(tie).alias("tie"), *more)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, text_hash, class_id (least doc_id of the connected texts), copy_of (least doc_id of the texts with the
    same words), n_links (other rows linked, copies included), first (whether doc_id and text are those of the class's first row)."""
    n = partitions(docs)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))
    # a text that a third of all documents have is one class: its documents are dealt by class and salt
    salted = table(signed_docs(docs, n), "signatures")
    salts = salted.groupBy("c1", "c2", "salt").agg(F.min(_first("doc", "tie", "sig")).alias("rep"), F.count(F.lit(1)).alias("k"))
    classes = salts.groupBy("c1", "c2").agg(F.min("rep").alias("rep"), F.sum("k").alias("copies"))
    reps = table(
        classes.select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "rep.doc", "rep.tie", "rep.sig", "copies"), "classes"
    )
    groups = table(candidates(reps.select("node", "sig"), n), "groups")
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    inside = groups.join(sizes, "label").join(reps.select("node", "doc", "tie", "copies"), "node").select(
        "node", F.col("doc").alias("of"), F.col("tie").alias("as"), "copies", F.col("label").alias("group"), "n"
    )
    same = F.col("of").eqNullSafe(F.col("doc")) & (F.col("as") == F.col("tie"))
    texts = inside.join(docs, same).dropDuplicates(["node"])  # rows that repeat a doc_id and its text
    linked = table(exact_links(texts.select("node", "copies", "text", "group", "n"), n), "links")
    counted = linked.groupBy("node").agg(F.sum("links").alias("links"), F.min("to").alias("to"), F.count_distinct("to").alias("ways"))
    if counted.where("ways > 1").isEmpty():
        label = counted.select("node", "links", F.col("to").alias("label"))
    else:  # some groups were compared in blocks: put their parts together
        joined = components(linked.select(F.col("node").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "at")
        label = counted.join(joined, F.col("node") == F.col("at"), "left").select("node", "links", F.coalesce("label", "to").alias("label"))
    ids = reps.select("node", "c1", "c2", "doc", "tie", "copies")
    heads = label.join(ids.select("node", "doc", "tie"), "node").groupBy("label").agg(F.min(_first("doc", "tie")).alias("head"))
    known = ids.join(label.join(heads, "label").select("node", "links", "head"), "node", "left")
    known = known.select(
        "c1",
        "c2",
        F.coalesce("head", _first("doc", "tie")).alias("head"),
        F.col("doc").alias("copy_of"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    member = salted.drop("sig").join(salts.select("c1", "c2", "salt").join(known, ["c1", "c2"]), ["c1", "c2", "salt"])
    first = F.col("doc").eqNullSafe(F.col("head.doc")) & (F.col("tie") == F.col("head.tie"))
    return member.select(
        F.col("doc").alias("doc_id"),
        F.col("tie").alias("text_hash"),
        F.col("head.doc").alias("class_id"),
        "copy_of",
        "n_links",
        first.alias("first"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "copy_of", "n_links")
