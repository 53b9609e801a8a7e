"""SentencePiece encoding and decoding with merge-type vocabularies.

A chunk's characters are its first symbols; an agenda of adjacent symbol pairs that form a piece, ordered by
score and then from left to right, says which to merge next. Characters without a piece become their UTF-8 bytes'
pieces. No piece has a space mark after another character, nor a line feed, so texts are split there and each distinct
chunk of a task is encoded once; ``_check_vocabulary`` makes sure of that. In every Arrow batch, all chunks that are new
to the task are encoded and decoded by the sentencepiece library too, and a difference fails the task. Each document is decoded from its ids.

Null counts as empty: begin and end ids only. Other columns pass through; those named like a result are replaced.
Repeated rows are each encoded. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import give_back
from .words import Memory, pieces

MARK = "▁"
NEVER = float("inf")


class MergeCodec:
    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.costs = {self.names[i]: -sp.get_score(i) for i in plain}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.values = {i: b for b, i in self.bytes.items()}
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self._check_vocabulary()
        #: What each id decodes to; begin and end to nothing.
        self.decoded = [b"" if i in (self.begin, self.end) else bytes([self.values[i]]) if i in self.values else n.replace(MARK, " ").encode() for i, n in enumerate(self.names)]
        self.memory = Memory(self._encode_checked)

    def _check_vocabulary(self) -> None:
        if any(MARK in p.lstrip(MARK) or (MARK in p and not p.strip(MARK) == p.lstrip(MARK)) or (p.startswith(MARK * 2) and p.strip(MARK)) or "\n" in p for p in self.ids):
            raise ValueError("pieces cross the places where texts are split")
        if len(self.bytes) != 256 or sum(map(self.library.is_unused, range(len(self.names)))):
            raise ValueError("a merge-type vocabulary with byte pieces and without unused ones is needed")

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a chunk whose spaces are marks."""
        symbols = self._short(chunk) if len(chunk) <= 48 else self._long(chunk)
        try:
            return [self.ids[s] for s in symbols]
        except KeyError:
            return [i for s in symbols for i in ([self.ids[s]] if s in self.ids else [self.bytes[b] for b in s.encode()])]

    def _short(self, chunk: str) -> list[str]:
        """The agenda as a list by place: its least entry, leftmost on ties, is merged next."""
        cost, never = self.costs.get, NEVER
        symbols = list(chunk)
        agenda = [cost(a + b, never) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (least := min(agenda)) != never:
            i = agenda.index(least)
            pair = symbols[i] + symbols.pop(i + 1)
            symbols[i] = pair
            del agenda[i]
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + pair, never)
            if i < len(agenda):
                agenda[i] = cost(pair + symbols[i + 1], never)
        return symbols

    def _long(self, chunk: str) -> list[str]:
        """The agenda as a heap."""
        costs = self.costs
        symbols = list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if (cost := costs.get(pair)) is not None:
                agenda.append((cost, i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or after[i] != j or symbols[i] + symbols[j] != pair:
                continue  # one of them was merged meanwhile
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (cost := costs.get(pair + symbols[k])) is not None:
                    heapq.heappush(agenda, (cost, i, k, pair + symbols[k]))
            if (k := before[i]) >= 0:
                if (cost := costs.get(symbols[k] + pair)) is not None:
                    heapq.heappush(agenda, (cost, k, i, symbols[k] + pair))
        return [s for s in symbols if s]

    def _encode_checked(self, chunks: list[str]) -> list[bytes]:
        """Encodes new chunks and compares each with the library, which puts a mark in front of a text itself. What doesn't
        begin with one mark and more is shown to it behind a line feed, where texts are split."""
        codes = [self.encode_chunk(c) for c in chunks]
        bare = [c[0] == MARK and len(c) > 1 for c in chunks]
        texts = [c[1:].replace(MARK, " ") if x else "\n" + c.replace(MARK, " ") for c, x in zip(chunks, bare, strict=True)]
        told = self.library.encode(texts, num_threads=1)
        before = [self.ids[MARK], self.bytes[10]]
        if told != [code if x else before + code for code, x in zip(codes, bare, strict=True)]:
            raise ValueError("sentencepiece encodes a chunk otherwise")
        if self.library.decode(told, num_threads=1) != texts:
            raise ValueError("sentencepiece decodes a chunk otherwise")
        return [array("I", c).tobytes() for c in codes]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Each starts with its marks; a line feed is a chunk of its own, and what follows it has none."""
        if not text:
            return []
        text = MARK + text.replace(" ", MARK)
        parts = text.replace("\n", "\0\n\0").split("\0") if "\0" not in text else _by_hand(text)
        out = []
        for p in parts:
            if not p:
                continue
            first, *rest = p.split(MARK)
            if first:
                out.append(first)
            if MARK * 2 in p or p.endswith(MARK):  # runs of spaces stay together, with the word after them
                marks = 0
                for w in rest:
                    marks += 1
                    if w:
                        out.append(MARK * marks + w)
                        marks = 0
                if marks:
                    out.append(MARK * marks)
            else:
                out += [MARK + w for w in rest]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids, with begin and end."""
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (self.begin, self.end))
        return [begin + code + end for code in self.memory.join([self.chunks(t) for t in texts])]

    def decode(self, code: bytes) -> bytes:
        """The UTF-8 bytes of what the library's decode(ids) gives: without begin and end, and without the mark that encoding put in front."""
        return b"".join(map(self.decoded.__getitem__, np.frombuffer(code, dtype="<u4").tolist()))[1:]


def _by_hand(text: str) -> list[str]:
    out = []
    for i, line in enumerate(text.split("\n")):
        out += ["\n", line] if i else [line]
    return out


assert array("I").itemsize == 4 and sys.byteorder == "little"
_codecs: dict[str, MergeCodec] = {}


def codec(path: str) -> MergeCodec:
    """One for each worker process."""
    if path not in _codecs:
        _codecs[path] = MergeCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str, *, ids: bool = False) -> DataFrame:
    """All columns of docs but text, and n_tokens, ids_sha256, decoded_sha256 and (if ids) the ids."""
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])]
    own = [c for c in docs.columns if c != "text" and c not in new]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            codes, sizes, hashes, decoded = [], [], [], []
            for part in pieces(texts):
                for code in c.encode(part):
                    sizes.append(len(code) // 4)
                    hashes.append(hashlib.sha256(code).hexdigest())
                    decoded.append(hashlib.sha256(c.decode(code)).hexdigest())
                    if ids:
                        codes.append(np.frombuffer(code, dtype="<u4").astype(np.int32).tolist())
            cols = [
                pa.array(sizes, pa.int64()),
                pa.array(hashes, pa.string()),
                pa.array(decoded, pa.string()),
                *([pa.array(codes, pa.list_(pa.int32()))] if ids else []),
            ]
            yield pa.record_batch(
                [*(b.column(f"__own_{i}") for i in range(len(own))), *cols],
                names=[*(f"__own_{i}" for i in range(len(own))), *(f"__{x}" for x in new)],
            )
        c.memory.forget()
        give_back()

    named = docs.select("text", *(F.col(f"`{x}`").alias(f"__own_{i}") for i, x in enumerate(own)))
    schema = named.drop("text").schema
    for name, kind in zip(new, ["long", "string", "string", T.ArrayType(T.IntegerType())], strict=False):
        schema = schema.add(f"__{name}", kind)
    return named.mapInArrow(scan, schema).select(
        *(F.col(f"__own_{i}").alias(x) for i, x in enumerate(own)), *(F.col(f"__{x}").alias(x) for x in new)
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
