"""Rows of packed arrays that move between tasks: numbers as compressed planes of bytes, keyed by a shard or by who asked."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from cadenza.llm.neardup import _groups

#: key: where a row goes; kind: its place among the rows of a key; owner: whom an answer goes to.
CELL = "key long, kind int, owner long, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned integers (or float32) as compressed planes of bytes."""
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a.view(np.uint32) if a.dtype == np.float32 else a).astype(np.uint64)
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        parts += [struct.pack("<IB", len(a), width), a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 1, []
    for _ in range(raw[0]):
        n, width = struct.unpack_from("<IB", raw, at)
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 5).reshape(width, n).T
        out.append(full.reshape(-1).view(np.uint64))
        at += 5 + n * width
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of a sorted array; np.cumsum takes them back."""
    return np.diff(a, prepend=np.uint64(0))


def floats(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32).view(np.float32)


def cells(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    key, kind, owner, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(owner, pa.int64()), pa.array(data, pa.binary())], names=["key", "kind", "owner", "data"])


def each_key(batches: Iterator[pa.RecordBatch], column: str = "key") -> Iterator[tuple[int, pa.Table]]:
    """The rows of one key at a time."""
    for t in _groups(batches, [column]):
        key = t.column(column).to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))).tolist()
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            yield int(key[i]), t.slice(i, j - i)


def met(df: DataFrame, run, schema: str, by: str = "key") -> DataFrame:
    """``run`` over rows that come by ``by`` and kind."""
    return df.repartition(by).sortWithinPartitions(by, "kind").mapInArrow(run, schema)


def pack_pair(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def unpack_pair(data: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(data[:8], "little")
    return data[8 : 8 + n], data[8 + n :]


def pack_strings(strings: list[bytes]) -> bytes:
    return pack_pair(pack(np.array([len(x) for x in strings], np.uint64)), zstandard.ZstdCompressor(level=6).compress(b"".join(strings)))


def unpack_strings(data: bytes) -> list[bytes]:
    size, blob = unpack_pair(data)
    blob = zstandard.ZstdDecompressor().decompress(blob)
    edge = np.concatenate(([0], np.cumsum(unpack(size)[0]))).astype(np.int64).tolist()
    return [blob[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]
