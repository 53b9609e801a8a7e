"""Token ids in shards, each a wavelet matrix in one compressed file.

A shard holds the ids of consecutive documents. Bit-planes, most significant first, are stably parted by
their bits; with counts of the set bits before each block they answer access (which id is at a place), rank (how
often an id is before a place), count and select (where is its k-th occurrence) without the ids themselves.

File: 8 bytes of magic, the head's length and the directory's compressed one, the head (JSON), the directory (the set bits and the
compressed bytes of each block of each plane), then zstd frames: the blocks, plane by plane, the documents' ids and their lengths.
``open_shard`` reads head and directory, and then the blocks that a question needs: one for each plane for an access, two for a rank,
wherever they are in a file of any size.

Documents are in ascending doc_id order: ranges of doc_id are dealt to tasks, which sort them. Null and empty texts
have the end id only. A null doc_id comes first, and rows that repeat a doc_id follow one another, in the order of a hash of their texts. Other columns are
ignored. An empty table writes no shards and gives an empty table. A task that runs again writes the same names; a file
appears under its name only when it is whole.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import opened, partitions, shared_folder, table
from .words import IdMemory, blocks

MAGIC = b"WMATRIX2"
END = 1
#: A special token of the vocabulary.
STOP = "<|endoftext|>"
#: Ids of a shard, beyond which the next document begins another one.
SHARD = 1 << 22
#: Bits of a plane's block.
STEP = 1 << 14
NULL = -(2**63)


class WaveletMatrix:
    """planes: a function (level, block) -> the block's bytes. ones: set bits of each block, a row for each plane."""

    def __init__(self, block: Callable[[int, int], np.ndarray], ones: np.ndarray, n: int):
        self.block, self.n, self.levels = block, n, len(ones)
        self.sums = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in ones]
        self.zeros = [n - int(s[-1]) for s in self.sums]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for level in range(bits - 1, -1, -1):
            one = (x >> level & 1).astype(np.uint8).view(bool)
            planes.append(np.packbits(one, bitorder="little"))
            x = np.concatenate([np.compress(~one, x), np.compress(one, x)])
        wide = STEP // 8
        ones = np.array([np.bitwise_count(np.pad(p, (0, -len(p) % wide)).reshape(-1, wide)).sum(axis=1, dtype=np.int64) for p in planes])
        return cls(lambda level, b: planes[level][b * wide : (b + 1) * wide], ones, len(ids))

    def blocks(self) -> int:
        return -(-self.n // STEP)

    def ids(self) -> np.ndarray:
        """All ids, in order."""
        x = np.zeros(self.n, dtype=np.uint32 if self.levels > 16 else np.uint16)
        for level in range(self.levels - 1, -1, -1):
            plane, zeros = np.concatenate(
                [self.block(level, b) for b in range(self.blocks())]
            ) if self.n else np.zeros(0, np.uint8), self.zeros[level]
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            back = np.empty_like(x)
            back[~one] = x[:zeros]
            back[one] = x[zeros:] | x.dtype.type(1 << (self.levels - 1 - level))
            x = back
        return x

    def _ones(self, level: int, i: int) -> int:
        """Set bits of a plane before place i."""
        a, rest = divmod(i, STEP)
        if not rest:
            return int(self.sums[level][a])
        return int(self.sums[level][a]) + int(np.unpackbits(self.block(level, a), count=rest, bitorder="little").sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.levels):
            bit = int(self.block(level, i // STEP)[i % STEP // 8] >> (i % 8) & 1)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out * 2 + bit
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        a, b = 0, i
        for level in range(self.levels):
            x, y = self._ones(level, a), self._ones(level, b)
            one = token >> (self.levels - 1 - level) & 1
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if one else (a - x, b - y)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """How often the token is before place i."""
        a, b = self._range(token, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence, from 0."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            i = self._select_bit(level, i - self.zeros[level], True) if i >= self.zeros[level] else self._select_bit(level, i, False)
        return i

    def _select_bit(self, level: int, k: int, one: bool) -> int:
        before = self.sums[level] if one else np.minimum(np.arange(len(self.sums[level])) * STEP, self.n) - self.sums[level]
        a = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.block(level, a), count=min(STEP, self.n - a * STEP), bitorder="little")
        return a * STEP + int(np.flatnonzero(bits == one)[k - int(before[a])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def write_shard(uri: str, ids: np.ndarray, bits: int, docs: np.ndarray, sizes: np.ndarray) -> int:
    """Returns the file's bytes."""
    pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
    m = WaveletMatrix.build(ids, bits)
    blocks = [pack(m.block(level, b).tobytes()) for level in range(bits) for b in range(m.blocks())]
    ones = np.diff(np.array(m.sums), axis=1).astype("<u2")
    directory = pack(ones.tobytes() + np.array([len(x) for x in blocks], dtype="<u2").tobytes())
    tail = [pack(docs.astype("<i8").tobytes()), pack(sizes.astype("<i8").tobytes())]
    head = json.dumps(
        {"n": len(ids), "bits": bits, "step": STEP, "docs": len(docs), "blocks": sum(map(len, blocks)), "tail": [len(x) for x in tail]}
    ).encode()
    where, path = opened(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    context = TaskContext.get()
    part = f"{path}.{context.taskAttemptId() if context else 0}.part"
    whole = b"".join([MAGIC, len(head).to_bytes(8, "little"), len(directory).to_bytes(8, "little"), head, directory, *blocks, *tail])
    with where.open_output_stream(part, compression=None) as f:
        f.write(whole)
    where.move(part, path)
    return len(whole)


class Shard:
    """An open shard: matrix answers from the blocks that it fetches, documents() gives the documents' ids and lengths.

    read counts the bytes that were fetched."""

    def __init__(self, uri: str):
        where, path = opened(uri)
        self.file, self.read = where.open_input_file(path), 0
        first = self._fetch(0, 24)
        if first[:8] != MAGIC:
            raise ValueError(f"{uri} is no shard")
        size, wide = (int.from_bytes(first[i : i + 8], "little") for i in (8, 16))
        self.head = head = json.loads(self._fetch(24, size))
        if head["step"] != STEP:
            raise ValueError(f"{uri} has blocks of {head['step']} bits")
        shape = (2, head["bits"], -(-head["n"] // STEP))
        ones, sizes = np.frombuffer(unpacked(self._fetch(24 + size, wide)), dtype="<u2").reshape(shape).astype(np.int64)
        self.begin = 24 + size + wide
        self.at = np.concatenate([[0], np.cumsum(sizes.ravel())])
        self.held: dict[int, np.ndarray] = {}
        self.matrix = WaveletMatrix(self._block, ones, head["n"])

    def _fetch(self, at: int, size: int) -> bytes:
        self.read += size
        return self.file.read_at(size, at)

    def _block(self, level: int, b: int) -> np.ndarray:
        k = level * self.matrix.blocks() + b
        if k not in self.held:
            if len(self.held) > 4096:
                self.held.clear()
            a, end = int(self.at[k]), int(self.at[k + 1])
            self.held[k] = np.frombuffer(unpacked(self._fetch(self.begin + a, end - a)), dtype=np.uint8)
        return self.held[k]

    def ids(self) -> np.ndarray:
        """All ids, by one read of all blocks."""
        data = memoryview(self._fetch(self.begin, self.head["blocks"]))
        planes = lambda level, b: np.frombuffer(unpacked(data[self.at[level * self.matrix.blocks() + b] : self.at[level * self.matrix.blocks() + b + 1]]), dtype=np.uint8)
        return WaveletMatrix(planes, np.diff(np.array(self.matrix.sums), axis=1), self.matrix.n).ids()

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.head["tail"]
        data = self._fetch(self.begin + self.head["blocks"], a + b)
        return tuple(np.frombuffer(unpacked(x), dtype="<i8") for x in (data[:a], data[a:]))

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def unpacked(frame: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(frame)


def open_shard(uri: str) -> Shard:
    return Shard(uri)


_memories: dict[str, tuple[IdMemory, int]] = {}


def _memory(path: str) -> tuple[IdMemory, int]:
    """The words that this worker has encoded, and the bits of an id. Texts are split only at ASCII white space, where the pre-tokenizer splits them too."""
    if path not in _memories:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        t = Tokenizer.from_file(path)
        stop = t.token_to_id(STOP)

        def encode(words: list[str]) -> list[np.ndarray]:
            """A hundred words at a time, with a special token between them; words that could hold one are encoded alone."""
            odd = {i: np.array(t.encode(w, add_special_tokens=False).ids, dtype=np.uint32) for i, w in enumerate(words) if "<|" in w}
            rows = [w if i not in odd else "" for i, w in enumerate(words)] if odd else words
            lines = t.encode_batch_fast([STOP.join(rows[i : i + 100]) for i in range(0, len(rows), 100)], add_special_tokens=False)
            ids = np.concatenate([np.array([*e.ids, stop], dtype=np.uint32) for e in lines])
            end = np.flatnonzero(ids == stop)
            out = [ids[a:b] for a, b in zip([0, *(end[:-1] + 1).tolist()], end.tolist(), strict=True)]
            for i, c in odd.items():
                out[i] = c
            return out

        _memories[path] = IdMemory(encode), max(t.get_vocab_size() - 1, END).bit_length()
    return _memories[path]


SUMMARY = "part int, seq int, uri string, before long, n_ids long"


def write_shards(docs: DataFrame, tokenizer: str, folder: str, shard: int = SHARD) -> DataFrame:
    """Writes the shards; returns a row for each: before counts the ids of the same part's earlier shards."""
    n = partitions(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, bits = _memory(tokenizer)
        part = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = seq = before = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, seq, before
            uri = f"{folder}/part-{part:05d}-{seq:05d}.wm"
            ids, keys, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            write_shard(uri, ids, bits, keys, sizes)
            out = pa.record_batch(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([uri]),
                    pa.array([before], pa.int64()),
                    pa.array([size], pa.int64()),
                ],
                names=["part", "seq", "uri", "before", "n_ids"],
            )
            held, size, seq, before = [], 0, seq + 1, before + size
            return out

        for b in batches:
            keys = pc.fill_null(b.column(0), NULL).to_numpy(zero_copy_only=False)
            row = 0
            for data, offs in blocks(b.column(1)):
                ids, sizes = memory.encode_block(data, offs)
                docs_ = len(sizes)
                at = np.arange(len(ids)) + np.repeat(np.arange(docs_), sizes)
                sizes = sizes + 1
                whole = np.full(len(ids) + docs_, END, dtype=np.uint32)
                whole[at] = ids
                cut = np.concatenate([[0], np.cumsum(sizes)])
                a = 0
                while a < docs_:  # up to the document that fills the shard
                    to = min(docs_, max(a + 1, int(np.searchsorted(cut, cut[a] + shard - size))))
                    held.append((whole[cut[a] : cut[to]], keys[row + a : row + to], sizes[a:to]))
                    size += int(cut[to] - cut[a])
                    a = to
                    if size >= shard:
                        yield close()
                row += docs_
        if held:
            yield close()

    # rows of one doc_id have an order too, so that a task that runs again writes the same files, and are dealt by it if they are many
    order = ["doc_id", "__hash", "text"]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("__hash", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "__hash").sortWithinPartitions(*order).select("doc_id", "text")
    return table(rows.mapInArrow(scan, SUMMARY), "shards")


ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_shards(shards: DataFrame) -> DataFrame:
    """A row for each document of the shards, from their files."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("all"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, not each document
    base = totals.select("part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with open_shard(uri) as shard:
                    ids, (docs, sizes) = shard.ids().astype("<u4").tobytes(), shard.documents()
                cut = np.concatenate([[0], np.cumsum(sizes)])
                at = (cut * 4).tolist()
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch(
                    [pa.array(docs, mask=docs == NULL), pa.array(start + cut[:-1]), pa.array(sizes), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = partitions(shards)
    placed = shards.join(base, "part").select("uri", (F.col("base") + F.col("before")).alias("start"))
    return placed.repartition(n, "uri").mapInArrow(scan, ROWS)


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_shards(write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), shared_folder(spark, "tokens")))
