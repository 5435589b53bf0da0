"""Word hashing shared by the operators that work on word windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

#: Words whose hash a worker remembers, some 40 MB; beyond that the table starts anew.
REMEMBERED = 1 << 18

#: Bytes of cells that an Arrow stage works on before it yields what it has.
SLICE_BYTES = 8 << 20

GAP = re.compile(rb"[\x20\x09-\x0D]")

U64 = np.uint64
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)  # fixed values: the 64-bit finalizer of MurmurHash3


class WordHash(dict):
    """word bytes -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


HASH = WordHash()


def ascii_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs of anything but [\\x20\\x09-\\x0D], which is how bytes.split() splits; lower folds A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_lists(text: str | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The same words, those of about `size` bytes of text at a time."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while at < len(raw):
        gap = GAP.search(raw, at + size)
        end = gap.start() if gap else len(raw)
        yield raw[at:end].split()
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * _M1
    x = (x ^ (x >> U64(33))) * _M2
    return x ^ (x >> U64(33))


def rolling(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of every window of k consecutive words, by doubling: O(log k) passes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    done, out, span, block, at = 0, None, 1, mix(hashes + U64(seed)), k
    while at:
        if at & 1:
            part = block[done : done + n]
            out = part if out is None else mix(out * U64(3) + part)
            done += span
        at >>= 1
        if at:
            block = mix(block[:-span] * U64(5) + block[span:])
            span *= 2
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices whose cells of one column hold about `most` bytes, one row at least.

    Arrow batches are bounded in rows; what a stage makes of one at a time is bounded by this.
    """
    sizes = np.nan_to_num(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64))
    total, begin = np.cumsum(sizes), 0
    while begin < batch.num_rows:
        done = total[begin - 1] if begin else 0.0
        end = max(begin + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
