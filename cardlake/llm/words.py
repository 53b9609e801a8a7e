"""Encoding of texts word by word with a bounded memory of words already seen."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from . import kernels as K


class Memory:
    """word -> encoded bytes. Two generations of up to limit words each: what is still in use survives, the rest goes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 200_000):
        self.encode, self.limit = encode, limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        self.new, self.old = {}, {}

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """The encodings of each text's words, one after the other."""
        known = self.new
        missing = set().union(*texts).difference(known)
        if missing:
            old = self.old
            unseen = []
            for w in missing:
                if (code := old.get(w)) is None:
                    unseen.append(w)
                else:
                    known[w] = code
            if unseen:
                known.update(zip(unseen, self.encode(unseen), strict=True))
        out = [b"".join(map(known.__getitem__, words)) for words in texts]
        if len(known) > self.limit:
            self.old, self.new = known, {}
        return out


def pieces(texts: list[str], size: int = 1 << 21):
    """Lists of consecutive texts of about size characters in all; a longer text is alone."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


class IdMemory:
    """Token ids of words: an open-addressing table in flat arrays, looked up for a whole batch at once by the words' 64-bit hashes.

    Every word that is found is compared with the one that was learned; a batch in which one differs is encoded without the table. When limit words are known, all are forgotten: frequent ones are soon back."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], limit: int = 1 << 20):
        self.encode, self.limit, self.mask = encode, limit, np.uint64(4 * limit - 1)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, dtype=np.uint64)
        self.rows = np.zeros(int(self.mask) + 1, dtype=np.int32)
        self.n = self.used = 0
        self.starts, self.sizes = np.zeros(self.limit * 2, np.int64), np.zeros(self.limit * 2, np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.text = np.zeros(1 << 16, dtype=np.uint8)
        self.letters, self.text_at, self.text_size = 0, np.zeros(self.limit * 2, np.int64), np.zeros(self.limit * 2, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rows of the hashes, or -1."""
        out = np.full(len(h), -1, dtype=np.int32)
        at, left = h & self.mask, np.arange(len(h))
        while len(left):
            k = self.keys[at]
            hit = k == h[left]
            out[left[hit]] = self.rows[at[hit]]
            go = ~hit & (k != 0)
            left, at = left[go], (at[go] + np.uint64(1)) & self.mask
        return out

    def learn(self, h: np.ndarray, words: list[bytes], codes: list[np.ndarray]) -> None:
        """Distinct new hashes."""
        self._remember(words)
        sizes = np.array([len(c) for c in codes], dtype=np.int32)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(h) > len(self.starts):
            self.starts, self.sizes = np.concatenate(
                [self.starts, np.zeros_like(self.starts)]
            ), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[self.n : self.n + len(h)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + len(h)] = sizes
        at, left = h & self.mask, np.arange(len(h))
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[left[free]]
            mine = self.keys[at] == h[left]
            self.rows[at[mine]] = self.n + left[mine]
            left, at = left[~mine], (at[~mine] + np.uint64(1)) & self.mask
        self.n += len(h)
        self.used += len(flat)

    def _remember(self, words: list[bytes]) -> None:
        raw, sizes = np.frombuffer(b"".join(words), dtype=np.uint8), np.array([len(w) for w in words], dtype=np.int32)
        while self.letters + len(raw) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        while self.n + len(words) > len(self.text_at):
            self.text_at, self.text_size = np.concatenate([self.text_at, np.zeros_like(self.text_at)]), np.concatenate(
                [self.text_size, np.zeros_like(self.text_size)]
            )
        self.text[self.letters : self.letters + len(raw)] = raw
        self.text_at[self.n : self.n + len(words)] = self.letters + np.cumsum(sizes) - sizes
        self.text_size[self.n : self.n + len(words)] = sizes
        self.letters += len(raw)

    def _same(self, data: np.ndarray, sizes: np.ndarray, row: np.ndarray) -> bool:
        """Whether the words of data are those of the rows."""
        if (self.text_size[row] != sizes).any():
            return False
        inside = data[K.SPACE[data]]  # the words, one after the other
        return bool((self.text[K.ranges(self.text_at[row], sizes)] == inside).all())

    def _exactly(self, words: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        different = list(dict.fromkeys(words))
        codes = dict(zip(different, self.encode([w.decode() for w in different]), strict=True))
        ids = [codes[w] for w in words]
        cut = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        return np.concatenate(ids), np.diff(cut[first])

    def encode_block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows' words, one after the other, and each row's number of ids."""
        start, end, first = K.word_spans(data, offs, K.SPACE)
        h = K.span_hashes(data, start, end) | np.uint64(1)
        row = self.find(h)
        new = np.flatnonzero(row < 0)
        if len(new):
            if self.n > self.limit:
                self.forget()
                new = np.arange(len(h))
            keys, at = np.unique(h[new], return_index=True)
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(start[new[at]].tolist(), end[new[at]].tolist(), strict=True)]
            self.learn(keys, words, self.encode([w.decode() for w in words]))
            row[new] = self.find(h[new])
        if not self._same(data, (end - start).astype(np.int64), row):
            raw = data.tobytes()
            return self._exactly([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], first)
        size = self.sizes[row].astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(size)])
        return self.ids[K.ranges(self.starts[row], size)], np.diff(cut[first])


def blocks(column: pa.Array, size: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of consecutive rows of about size bytes in all; a longer text is alone."""
    data, offs = K.text_bytes(column)
    a = 0
    while a < len(offs) - 1:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, side="right")) - 1)
        yield data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b
