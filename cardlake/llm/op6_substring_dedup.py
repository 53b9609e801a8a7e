"""Substring deduplication over words by prefix-partitioned suffix trees.

A document's words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Suffixes, cut at 20 words, are split into groups by prefixes of 5, 10, 15 or
20 words, each as long as it takes for a group to fit the memory of a task. A group's suffixes in the order of their words (of
the words' 64-bit hashes), with the number of words that neighbours have in common, give the group's suffix tree: its internal nodes are the
ranges of leaves that share a number of words and no more. The nodes at depth 20 are the repeated windows, which laid end
to end are the maximal repeats; all their leaves but the first go. A group of the longest prefix is a single node, whatever its size.

A record for each suffix would be some thirty times the input. So copies of whole passages, and suffixes that have their rarest five
words for themselves, are told first, in runs of neighbours (see ``repeats``); the suffixes that are left, where passages
begin, end or were edited, make the trees.

Nulls and texts without words: nothing removed. Rows of the same doc_id (or without one) and the same text count as
one document; those of different texts are documents of their own, in the order of xxhash64(text). A null doc_id counts as smaller
than all others. Other columns pass through, whatever their names, but those named like a result are replaced. An empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R

THRESHOLD = 20
GRAM = 5
BLOCK = 4
#: Suffixes that a prefix's group may have before the prefix grows.
GROUP = 200_000
LEVELS = 4


def suffixes(pieces: DataFrame, depth: int = THRESHOLD) -> DataFrame:
    """Each window of the open pieces as the suffix that begins there: its words' hashes (8 bytes each), and where it is."""
    i = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")
    rows = pieces.select("content", "doc", "tie", "start", i)
    return rows.select(
        F.col("content").substr(8 * F.col("i") + 1, F.lit(8 * depth)).alias("words"),
        "doc",
        "tie",
        (F.col("start") + F.col("i")).alias("start"),
    )


def prefix(level: int, depth: int = THRESHOLD) -> Column:
    """The first level quarters of a suffix."""
    return F.xxhash64(F.substring("words", 1, 8 * (depth * level // LEVELS)))


def prefix_lengths(rows: DataFrame, group: int, depth: int = THRESHOLD) -> DataFrame:
    """(p1, p2, p3, length): the prefixes whose first quarter has more than group suffixes, and how many quarters (2 to 4) a group there takes."""
    parts = ["p1", "p2", "p3"]
    counts = rows.groupBy(*(prefix(i, depth).alias(p) for i, p in enumerate(parts, 1))).agg(F.count(F.lit(1)).alias("of"))
    large = counts.groupBy("p1").agg(F.sum("of").alias("all")).where(F.col("all") > group).select("p1")
    two = F.sum("of").over(Window.partitionBy("p1", "p2"))
    length = F.when(two <= group, 2).when(F.col("of") <= group, 3).otherwise(4)
    return counts.join(large, "p1", "left_semi").select(*parts, length.alias("length"))


def tree(words: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The internal nodes of the suffix trees of sorted suffixes (a row of words each; cut: where each group begins, and the end): depth, and (first leaf, end) of each.

    common[i] is what suffixes i and i + 1 share; a node of depth d is a longest range of leaves whose neighbours share d or more words, some of them d."""
    n, width = words.shape
    differ = words[1:] != words[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if n > 1 else np.zeros(0, np.int64)
    if cut is not None:
        common[cut[1:-1] - 1] = -1
    depths, spans = [], []
    for d in np.unique(common[common >= 0]):
        edge = np.flatnonzero(np.concatenate([[True], common < d, [True]]))  # between leaves edge - 1 and edge
        first, end = edge[:-1], edge[1:]
        is_d = np.concatenate([[0], np.cumsum(common == d)])
        node = is_d[end - 1] > is_d[first]
        depths.append(np.full(int(node.sum()), d))
        spans.append(np.stack([first[node], end[node]], axis=1))
    if not depths:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    return np.concatenate(depths), np.concatenate(spans)


def subtrees(pieces: DataFrame, n: int, group: int = GROUP, depth: int = THRESHOLD) -> DataFrame:
    """Marks of the leaves of deep internal nodes, except each node's first."""
    rows = suffixes(pieces, depth)
    lengths = prefix_lengths(rows, group, depth)
    parts = [prefix(i, depth).alias(f"p{i}") for i in range(1, LEVELS + 1)]
    length = F.coalesce(F.col("length"), F.lit(1))
    key = F.element_at(F.array(*(F.col(f"p{i}") for i in range(1, LEVELS + 1))), length)
    dealt = rows.select("*", *parts).join(lengths, ["p1", "p2", "p3"], "left").select(key.alias("prefix"), "words", "doc", "tie", "start")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in K.grouped(batches, ["prefix"], 1 << 14, most=2 * group, same="words"):
            raw, _ = K.text_bytes(t.column("words"))
            words = raw.view(">u8").reshape(-1, depth)
            doc, tie, start = (t.column(c).to_numpy() for c in ("doc", "tie", "start"))
            deep, span = tree(words, cut)
            span = span[deep >= depth]
            size = span[:, 1] - span[:, 0]
            leaf, head = K.ranges(span[:, 0], size), np.repeat(span[:, 0], size)
            again = leaf[(doc[leaf] != doc[head]) | (tie[leaf] != tie[head]) | (start[leaf] != start[head])]
            yield R.as_marks(doc[again], tie[again], start[again])

    return dealt.repartition(n, "prefix").sortWithinPartitions("prefix", "words", "doc", "tie", "start").mapInArrow(scan, R.MARKS)


def remove_repeated_words(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """All columns of docs but text, and n_words, n_removed, kept_sha256 and kept (the words left, joined by one space)."""
    new = ["n_words", "n_removed", "kept_sha256", "kept"]
    own = [c for c in docs.columns if c != "text"]
    rows = R.marked(R.keyed(docs), R.word_elements, threshold, gram, BLOCK, lambda x, n: subtrees(x, n, group, threshold))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.small(batches):
            data, offs = K.text_bytes(b.column("text"))
            start, end, first = K.word_spans(data, offs, K.SPACE)
            keep = R.kept_elements(b, first, threshold)
            size = end[keep] - start[keep] + 1
            at = K.ranges(start[keep], size)
            text = data[np.minimum(at, len(data) - 1)] if len(at) else np.zeros(0, np.uint8)
            text[np.cumsum(size) - 1] = 0x20
            count = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[first]
            cut = np.concatenate([[0], np.cumsum(size)])[count].tolist()
            whole = text.tobytes()
            parts = [whole[i : max(i, j - 1)] for i, j in zip(cut[:-1], cut[1:], strict=True)]
            words = np.diff(first)
            cols = [
                (words, pa.int64()),
                (words - np.diff(count), pa.int64()),
                ([hashlib.sha256(x).hexdigest() for x in parts], pa.string()),
                ([x.decode() for x in parts], pa.string()),
            ]
            yield pa.record_batch(
                [*(b.column(f"__own_{i}") for i in range(len(own))), *(pa.array(c, kind) for c, kind in cols)],
                names=[*(f"__own_{i}" for i in range(len(own))), *(f"__{c}" for c in new)],
            )

    named = rows.select("text", *R.PASSES, *(f"__own_{i}" for i in range(len(own))))
    schema = named.select(*(f"__own_{i}" for i in range(len(own)))).schema
    for name, kind in zip(new, ["long", "long", "string", "string"], strict=True):
        schema = schema.add(f"__{name}", kind)
    out = named.mapInArrow(scan, schema)
    return out.select(*(F.col(f"__own_{i}").alias(c) for i, c in enumerate(own) if c not in new), *(F.col(f"__{c}").alias(c) for c in new))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_words(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
