"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces of the product of their probabilities, which a forward pass gives; a text's is the product over its
words, and its language the likeliest. The probabilities are fitted by expectation-maximisation, with forward and backward passes.

Words are lower case, split at spaces and line feeds, without what is no letter at either end; they may be of any length, and all pieces of
the vocabulary take part. Characters without a piece count as unlikely pieces of their own.

Fitted on at most SAMPLE documents of each language (those of the least hashes of doc_id and text) and all their words; whole texts are read
in tasks, and counts of words come to the driver. Texts that are null or have no letter get ``und`` and 0;
so do all if nothing could be learned. Null languages and held-out rows teach nothing. Rows that repeat a doc_id are each judged. A null doc_id
is not held out. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .words import Memory, pieces

SAMPLE = 600
#: Words of more characters go through the passes one by one.
USUAL = 40
MARK = "▁"
UNSEEN = 1e-7
SMOOTH = 0.05
EDGES = regex.compile(r"^[^\p{L}]+|[^\p{L}]+$")


class Pieces:
    """A vocabulary's pieces, found by hash."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {
            sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))
        }
        names = sorted(p for p in names if p.strip(MARK))
        by_size: dict[int, list[str]] = {}
        for p in names:
            by_size.setdefault(len(p), []).append(p)
        self.hashes, self.numbers, self.n, self.longest = {}, {}, len(names), max(by_size)
        number = {p: i for i, p in enumerate(names)}
        for size, group in by_size.items():
            h = self._hash(np.array([[ord(c) for c in p] for p in group], dtype=np.uint64), 0, size)
            order = np.argsort(h)
            self.hashes[size], self.numbers[size] = h[order], np.array([number[p] for p in group])[order]

    @staticmethod
    def _hash(chars: np.ndarray, a: int, b: int) -> np.ndarray:
        h = np.zeros(len(chars), dtype=np.uint64)
        for i in range(a, b):
            h = K.mix(h * np.uint64(K.BASE) + chars[:, i] + np.uint64(1))
        return h

    def lattice(self, chars: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(start, end, piece of each row or -1) of words of one length; the piece of an unknown character is n."""
        size = chars.shape[1]
        out = []
        for a in range(size):
            h = np.zeros(len(chars), dtype=np.uint64)
            for b in range(a + 1, min(size, a + self.longest) + 1):
                h = K.mix(h * np.uint64(K.BASE) + chars[:, b - 1] + np.uint64(1))
                have = self.hashes.get(b - a)
                if have is None:
                    which = np.full(len(chars), -1)
                else:
                    i = np.minimum(np.searchsorted(have, h), len(have) - 1)
                    which = np.where(have[i] == h, self.numbers[b - a][i], -1)
                if b == a + 1:
                    which = np.where(which < 0, self.n, which)
                if (which >= 0).any():
                    out.append((a, b, which))
        return out


    def spans(self, chars: np.ndarray) -> list[np.ndarray]:
        """For each length from 1 on, the piece (or -1) at each place of one word; the piece of an unknown character is n."""
        h, out = np.zeros(len(chars), dtype=np.uint64), []
        for size in range(1, min(self.longest, len(chars)) + 1):
            h = K.mix(h[: len(chars) - size + 1] * np.uint64(K.BASE) + chars[size - 1 :] + np.uint64(1))
            have = self.hashes.get(size)
            if have is None:
                which = np.full(len(h), -1)
            else:
                i = np.minimum(np.searchsorted(have, h), len(have) - 1)
                which = np.where(have[i] == h, self.numbers[size][i], -1)
            out.append(np.where(which < 0, self.n, which) if size == 1 else which)
        return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and characters of the words of each length."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        if n:
            yield at, np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n).astype(np.uint64)


def forward(lattice: list[tuple[int, int, np.ndarray]], size: int, rows: int, p: np.ndarray) -> np.ndarray:
    """Sums over segmentations of the first 0..size characters. p: a row for each piece, the unknown one, and one of zeros; a column for each language."""
    alpha = np.zeros((size + 1, rows, p.shape[1]))
    alpha[0] = 1
    for a, b, which in lattice:  # in order of a, so alpha[a] is whole
        alpha[b] += alpha[a] * p[which]
    return alpha


def long_word(vocabulary: Pieces, word: str, p: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations of one word of any length, for each language: the forward pass with the last sums only, rescaled as it goes."""
    chars = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    spans = vocabulary.spans(chars)
    reach = len(spans)
    alpha = np.zeros((reach, p.shape[1]))  # alpha[-k]: the sum of the segmentations of all but the next k - 1 characters
    alpha[-1] = 1
    scale = np.zeros(p.shape[1])
    for b in range(1, len(chars) + 1):
        sizes = np.arange(1, min(reach, b) + 1)
        new = (alpha[-sizes] * p[[spans[k - 1][b - k] for k in sizes.tolist()]]).sum(axis=0)
        alpha = np.concatenate([alpha[1:], new[None]])
        top = alpha.max(axis=0)
        alpha /= top
        scale += np.log(top)
    return np.log(np.maximum(alpha[-1], 1e-300)) + scale


def long_counts(vocabulary: Pieces, word: str, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and how often each is expected in one word of any length, over all its segmentations: forward and backward passes in logarithms."""
    chars = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n, spans = len(chars), vocabulary.spans(chars)
    with np.errstate(divide="ignore"):
        logs = [np.log(p[x]) for x in spans]  # logs[k - 1][a]: of the piece from a to a + k; -inf for none
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0
    for b in range(1, n + 1):
        alpha[b] = np.logaddexp.reduce([alpha[b - k] + logs[k - 1][b - k] for k in range(1, min(len(logs), b) + 1)])
    for a in range(n - 1, -1, -1):
        beta[a] = np.logaddexp.reduce([beta[a + k] + logs[k - 1][a] for k in range(1, min(len(logs), n - a) + 1)])
    expected = [np.exp(alpha[: n + 1 - k] + x + beta[k:] - alpha[n]) for k, x in enumerate(logs, 1)]
    which, often = np.concatenate(spans), np.concatenate(expected)
    return which[which >= 0], often[which >= 0]


def fit_pieces(vocabulary: Pieces, words: list[str], counts: np.ndarray, steps: int = 4) -> np.ndarray:
    """Probabilities of the pieces (and last of unknown characters) that make the words likely."""
    p = np.full((vocabulary.n + 2, 1), 1 / vocabulary.n)
    p[-2], p[-1] = UNSEEN, 0
    long = [i for i, w in enumerate(words) if len(w) > USUAL]  # they are rare, and their sums would underflow: one by one, in logarithms
    lattices = [(at, chars.shape[1], vocabulary.lattice(chars)) for at, chars in _by_length([w if len(w) <= USUAL else "" for w in words])]
    for _ in range(steps):
        seen = np.zeros(vocabulary.n + 2)
        for at, size, lattice in lattices:
            alpha = forward(lattice, size, len(at), p)[..., 0]
            beta = np.zeros_like(alpha)
            beta[size] = 1
            for a, b, which in lattice[::-1]:
                beta[a] += beta[b] * p[which, 0]
            whole = counts[at] / np.maximum(alpha[size], 1e-300)
            for a, b, which in lattice:
                seen += np.bincount(which % (vocabulary.n + 2), alpha[a] * p[which, 0] * beta[b] * whole, vocabulary.n + 2)
        for i in long:
            which, often = long_counts(vocabulary, words[i], p[:, 0])
            np.add.at(seen, which, often * counts[i])
        p[: vocabulary.n, 0] = (seen[: vocabulary.n] + SMOOTH) / (seen[: vocabulary.n].sum() + SMOOTH * vocabulary.n)
    return p[:, 0]


def clean(word: str) -> str:
    """The marked word; empty if it has no letter."""
    w = word if word.isalpha() else EDGES.sub("", word)
    return MARK + w.lower() if w else ""


def split(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    def __init__(self, languages: list[str], probabilities: np.ndarray, path: str):
        self.languages, self.p, self.path = languages, probabilities, path
        self.vocabulary: Pieces | None = None

    def word_scores(self, words: list[str]) -> list[bytes]:
        """Log probabilities of each word by language, as 64-bit floats."""
        self.vocabulary = self.vocabulary or Pieces(self.path)
        marked = [clean(w) for w in words]
        out = np.zeros((len(words), len(self.languages)))
        for at, chars in _by_length([w if len(w) <= USUAL else "" for w in marked]):
            for i in range(0, len(at), 20_000):
                rows = at[i : i + 20_000]
                c = chars[i : i + 20_000]
                out[rows] = np.log(np.maximum(forward(self.vocabulary.lattice(c), c.shape[1], len(rows), self.p)[-1], 1e-300))
        for i, w in enumerate(marked):
            if len(w) > USUAL:
                out[i] = long_word(self.vocabulary, w, self.p)
        raw, n = out.astype(np.float32).tobytes(), 4 * out.shape[1]
        return [raw[i : i + n] for i in range(0, len(raw), n)]


def fit(docs: DataFrame, path: str, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text, lang; rows held out and null languages are not read."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # a row for each language
    name = F.xxhash64("doc_id", "text")  # rows without a doc_id, or sharing one, are told apart
    few = known.join(F.broadcast(sizes), "lang").where(F.pmod(name, F.lit(1_000_000)) < F.lit(2e6 * sample) / F.col("n"))
    order = Window.partitionBy("lang").orderBy(name, "doc_id", "text")
    picked = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(split(text))
            for lang, seen in by.items():
                parts: Counter = Counter()
                for w, k in seen.items():
                    if x := clean(w):
                        parts[x] += k
                if parts:
                    yield pa.record_batch(
                        [pa.array([lang] * len(parts)), pa.array(list(parts)), pa.array(list(parts.values()), pa.int64())],
                        names=["lang", "word", "n"],
                    )

    counts = picked.select("lang", "text").mapInArrow(
        count, "lang string, word string, n long"
    ).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = counts.orderBy("lang", "word").toPandas()  # the words of at most sample documents a language
    languages = sorted(rows.lang.unique())
    if not languages:
        return Model([], np.zeros((0, 0)), path)
    vocabulary = Pieces(path)
    p = np.stack([fit_pieces(vocabulary, (own := rows[rows.lang == x]).word.tolist(), own.n.to_numpy(float)) for x in languages], axis=1)
    return Model(languages, p, path)


_memories: dict[int, Memory] = {}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the language's posterior probability, all being as likely before)."""
    key = hash((model.p.tobytes(), tuple(model.languages)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _memories:
            _memories.clear()
            _memories[key] = Memory(model.word_scores)
        memory = _memories[key]
        n = len(model.languages)
        for b in K.small(batches, "text", 16 << 20):
            pred, score = [], []
            for texts in pieces([t or "" for t in b.column(1).to_pylist()]):
                for code in memory.join([split(t) for t in texts]) if n else texts:
                    if not n:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    z = np.frombuffer(code, dtype=np.float32).reshape(-1, n).sum(axis=0, dtype=float)
                    i = int(z.argmax())
                    pred.append(model.languages[i])
                    score.append(float(1 / np.exp(z - z[i]).sum()))
            yield pa.record_batch(
                [b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), b.column(2)],
                names=["doc_id", "lang_pred", "score", "letters"],
            )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    out = docs.select(F.col("doc_id").cast("long"), "text", letters).mapInArrow(
        scan, "doc_id long, lang_pred string, score double, letters boolean"
    )
    return out.select(
        "doc_id",
        F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
