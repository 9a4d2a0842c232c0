"""Static range asymmetric numeral system over token ids.

One frequency table, quantised to ``2 ** SCALE_BITS``, serves all files of a
data set. Ids are cut into independent blocks. In a block, token ``t`` belongs
to lane ``t % lanes``; all lanes advance together as numpy vectors and share one
stream of 32-bit words: at each step the lanes that need a word take the next
ones in lane order. Every ``CHECKPOINT_STEPS`` steps the lane states and stream
position are stored, so decoding can begin there. States lie in [2^31, 2^63).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
LANES = 2048
CHECKPOINT_STEPS = 256
BLOCK_TOKENS = 1 << 20


class FrequencyTable:
    """Quantised frequencies; every id that occurs keeps at least one slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        if int(self.freq.sum()) != 1 << SCALE_BITS:
            raise ValueError("frequencies must sum to the scale")
        ends = np.cumsum(self.freq)
        self.start = ends - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.limit = self.freq << np.uint64(63 - SCALE_BITS)

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> FrequencyTable:
        counts = np.asarray(counts, np.int64)
        total = int(counts.sum())
        if not total:
            counts, total = np.where(np.arange(len(counts)) == 0, 1, 0), 1
        seen = counts > 0
        scale = 1 << SCALE_BITS
        if int(seen.sum()) > scale:
            raise ValueError("more ids than slots")
        freq = np.where(seen, np.maximum(1, (counts.astype(object) * scale // total).astype(np.int64)), 0)
        order = np.lexsort((np.arange(len(freq)), -freq))
        excess = int(freq.sum()) - scale
        if excess < 0:
            freq[order[0]] -= excess
        while excess > 0:  # take from the most frequent ids, which lose least by it
            top = order[: max(1, int((freq > 1).sum()))]
            take = np.minimum(freq[top] - 1, -(-excess // len(top)))
            take = np.where(np.cumsum(take) <= excess, take, np.maximum(0, excess - (np.cumsum(take) - take)))
            freq[top] -= take
            excess -= int(take.sum())
        return cls(freq)

    def to_bytes(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> FrequencyTable:
        return cls(np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64))


_HEAD = struct.Struct("<IIIII")  # tokens, lanes, words, checkpoints, crc32 of the ids


def encode_block(ids: np.ndarray, table: FrequencyTable) -> bytes:
    """One block: head, checkpoints (step, position, states), words."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    written = 0
    shift = np.uint64(SCALE_BITS)
    for step in range(steps - 1, -1, -1):
        symbols = ids[step * lanes : (step + 1) * lanes]
        part = x[: len(symbols)]
        freq = table.freq[symbols]
        full = part >= table.limit[symbols]
        out = part[full].astype(np.uint32)
        words.append(out)
        written += len(out)
        part = np.where(full, part >> WORD, part)
        quotient = part // freq
        x[: len(symbols)] = (quotient << shift) + (part - quotient * freq) + table.start[symbols]
        if step % CHECKPOINT_STEPS == 0:
            marks.append((step, written, x.tobytes()))
    stream = np.concatenate(words[::-1]).astype("<u4") if words else np.zeros(0, "<u4")
    marks = [(s, written - w, state) for s, w, state in marks[::-1]] or [(0, 0, x.tobytes())]
    crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
    head = _HEAD.pack(n, lanes, len(stream), len(marks), crc)
    return b"".join([head, *[struct.pack("<II", s, p) + state for s, p, state in marks], stream.tobytes()])


def decode_block(data: bytes, table: FrequencyTable, from_mark: int = 0, marks: int | None = None) -> np.ndarray:
    """The ids of a block, or of ``marks`` stretches from checkpoint ``from_mark`` on.

    A whole block is verified against its checksum.
    """
    n, lanes, n_words, n_marks, crc = _HEAD.unpack_from(data)
    size = 8 + 8 * lanes
    places = [struct.unpack_from("<II", data, _HEAD.size + i * size) for i in range(n_marks)]
    stream = np.frombuffer(data, "<u4", n_words, _HEAD.size + n_marks * size).astype(np.uint64)
    steps = -(-n // lanes)
    upto = n_marks if marks is None else min(n_marks, from_mark + marks)
    first = places[from_mark][0]
    last = steps if upto == n_marks else places[upto][0]
    at = places[from_mark][1]
    x = np.frombuffer(data, np.uint64, lanes, _HEAD.size + from_mark * size + 8).copy()
    out = np.empty((last - first) * lanes, np.uint32)
    mask, shift = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    for step in range(first, last):
        width = min(lanes, n - step * lanes)
        part = x[:width]
        slot = part & mask
        symbols = table.symbol[slot]
        part = table.freq[symbols] * (part >> shift) + slot - table.start[symbols]
        low = np.flatnonzero(part < LOW)
        part[low] = (part[low] << WORD) | stream[at : at + len(low)]
        at += len(low)
        x[:width] = part
        out[(step - first) * lanes : (step - first) * lanes + width] = symbols
    out = out[: min(n, last * lanes) - first * lanes]
    if first == 0 and last == steps and zlib.crc32(np.ascontiguousarray(out, "<u4")) != crc:
        raise ValueError("block checksum does not match")
    return out
