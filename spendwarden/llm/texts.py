"""Arrow string columns as flat bytes, and words on them, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
WORD = np.zeros(256, bool)  # ASCII letters and digits, and every byte of a longer UTF-8 sequence
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    a = pc.fill_null(column.cast(pa.large_string()), "")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about limit bytes of text each, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values with well spread bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _ODD, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of flat texts: runs of word bytes that don't cross a text's end.

    starts, ends: byte positions; of: offsets of each text's words; hash: 64-bit value of each word's bytes.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, member: np.ndarray = WORD):
        n = len(data)
        self.data = data
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = member[data]
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        first[edge] |= inside[1:-1][edge]
        last[edge - 1] |= inside[1:-1][edge - 1]
        self.inside = inside[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.starts, at)
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            if not len(self.starts):
                self._hash = np.zeros(0, np.uint64)
            else:
                length = self.ends - self.starts
                span = np.diff(np.append(self.starts, len(self.data)))
                place = np.arange(self.starts[0], len(self.data)) - np.repeat(self.starts, span)
                tail = slice(self.starts[0], None)
                power = powers(int(length.max()))
                value = np.where(self.inside[tail], (self.data[tail].astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, len(power) - 1)], np.uint64(0))
                self._hash = mix(np.add.reduceat(value, self.starts - self.starts[0]) + length.astype(np.uint64) * _ODD)
        return self._hash


def runs_of(hashes: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of width words in a row, offsets per text); a text of fewer words has all its words as one run, one without words none."""
    count = np.diff(of)
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(of), np.int64)
    power = powers(width + 1) * _ODD
    full = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        full[: n - k] += mix(hashes[k:]) * power[k]
    keep = np.maximum(count - width + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(keep)])
    take = np.arange(out_at[-1]) - np.repeat(out_at[:-1], keep) + np.repeat(of[:-1], keep)
    out = full[take]
    for i in np.flatnonzero((count > 0) & (count < width)):
        out[out_at[i]] = (mix(hashes[of[i] : of[i + 1]]) * power[: count[i]]).sum(dtype=np.uint64)
    return mix(out), out_at
