"""Words of whole texts as arrays of 64-bit hashes, for the operators that compare texts."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Words whose hashes a worker remembers; the memory is emptied when it is full.
CACHE_WORDS = 60_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        else:
            self.clear()
        return value


_HASH = _Hashes()


def free_name(taken: list[str], name: str) -> str:
    """`name`, with as many underscores as it takes to be none of the columns `taken`."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns named c0, c1, ..., so that added columns clash with none, and the
    new name of each."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()  # bytes: ASCII rules only


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values: polynomial sums, so any n costs the same."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(_STEP, len(h)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * _powers(_BACK, len(h) - n + 1))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def release() -> None:
    """Give what this worker has freed back to the system, where the C library can: the JVM of its executor and
    other workers share the memory. Large texts leave much of it free but held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def text_parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about `most` bytes of text each. What the range before took is released first."""
    values = batch.column(column)
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    at = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    begin = 0
    while begin < len(values):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield begin, min(end, len(values))
        release()
        begin = end
