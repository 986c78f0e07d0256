"""Files of token ids, each id in the fewest bits that the vocabulary needs.

Layout, little-endian: a header of eight 64-bit numbers (magic, bits an id, ids a block, ids, documents, blocks, 0, 0);
document ids and a byte each that tells whether they are null; where each document's ids start; the byte where each
block starts in the payload; the payload. An id i of a block stands at bit i * bits, so that any block, document or
range can be read alone and unpacked with a few numpy operations.
"""

from __future__ import annotations

import io

import numpy as np

MAGIC, BLOCK = 0x31304B4341504449, 8192


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids take ``bits`` bytes; the last group is filled up with zeros."""
    n = -(-len(ids) // 8) * 8
    rows = np.zeros(n, np.uint64)
    rows[: len(ids)] = ids
    rows = rows.reshape(-1, 8)
    out = np.zeros((len(rows), bits), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        value = rows[:, k] << np.uint64(shift)
        for j in range((shift + bits + 7) // 8):
            out[:, byte + j] |= (value >> np.uint64(8 * j)).astype(np.uint8)
    return out.tobytes()


def unpack(payload: bytes | np.ndarray, bits: int, first: int, stop: int) -> np.ndarray:
    """Ids first to stop of a block."""
    raw = np.frombuffer(payload, np.uint8)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    at = np.arange(first, stop, dtype=np.int64) * bits
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    value = np.zeros(len(at), np.uint64)
    for j in range((bits + 14) // 8):
        value |= raw[byte + j].astype(np.uint64) << np.uint64(8 * j)
    return ((value >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Takes ids as they come; keeps packed blocks and less than one block of plain ids."""

    def __init__(self, vocabulary: int, block: int = BLOCK):
        self.bits, self.block = bits_for(vocabulary), block
        self.docs: list[int] = []
        self.nulls: list[bool] = []
        self.starts = [0]
        self.blocks: list[bytes] = []
        self.rest: list[np.ndarray] = []
        self.n_rest = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.docs += [d or 0 for d in doc_ids]
        self.nulls += [d is None for d in doc_ids]
        self.starts += (self.starts[-1] + np.cumsum(sizes)).tolist()
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= self.block:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.int64)
        stop = len(ids) if all_ else len(ids) // self.block * self.block
        self.blocks += [pack(ids[i : min(i + self.block, stop)], self.bits) for i in range(0, stop, self.block)]
        self.rest, self.n_rest = [ids[stop:]], len(ids) - stop

    def write(self, out: io.RawIOBase) -> None:
        self._flush(True)
        offsets = np.cumsum([0, *map(len, self.blocks)])
        out.write(np.asarray([MAGIC, self.bits, self.block, self.starts[-1], len(self.docs), len(self.blocks), 0, 0], "<u8").tobytes())
        for values, kind in ((self.docs, "<i8"), (self.nulls, "u1"), (self.starts, "<u8"), (offsets, "<u8")):
            out.write(np.asarray(values, kind).tobytes())
        for b in self.blocks:
            out.write(b)


class Reader:
    """Over a seekable binary file."""

    def __init__(self, file: io.RawIOBase):
        self.file = file
        head = np.frombuffer(file.read(64), "<u8").astype(np.int64)
        if len(head) < 8 or head[0] != MAGIC:
            raise ValueError("not a file of packed ids")
        _, self.bits, self.block, self.n_ids, self.n_docs, n_blocks = head[:6].tolist()
        self.doc_ids = np.frombuffer(file.read(8 * self.n_docs), "<i8")
        self.nulls = np.frombuffer(file.read(self.n_docs), "u1").astype(bool)
        self.starts = np.frombuffer(file.read(8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(file.read(8 * (n_blocks + 1)), "<u8").astype(np.int64)
        self.payload = 64 + 17 * self.n_docs + 8 + 8 * (n_blocks + 1)

    def ids(self, first: int, stop: int) -> np.ndarray:
        """Ids first to stop of the file; reads their blocks only."""
        if stop <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (stop - 1) // self.block
        self.file.seek(self.payload + int(self.offsets[a]))
        raw = self.file.read(int(self.offsets[b + 1] - self.offsets[a]))
        parts = []
        for k in range(a, b + 1):
            lo, hi = int(self.offsets[k] - self.offsets[a]), int(self.offsets[k + 1] - self.offsets[a])
            parts.append(unpack(raw[lo:hi], self.bits, max(first - k * self.block, 0), min(stop - k * self.block, self.block)))
        return np.concatenate(parts)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))
