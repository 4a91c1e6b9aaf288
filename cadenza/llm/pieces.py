"""SentencePiece encoding and decoding by a table of distinct marked words.

White space becomes the marker U+2581 and every text gets one in front. When no piece of the model holds a marker after
another character, no merge can cross from a word into the marker that follows, so a text's segmentation is that of its
marked words (a run of markers and what follows up to the next) put one after the other:

1. Each task gathers texts up to some bytes and numbers their distinct marked words. What is left of the texts is
   the numbers of their words in order.
2. Distinct words go to shards by a hash. There every word is segmented once, whichever texts have it, and its ids go back to those who asked.
3. Where a gathering meets the ids of its words, texts' ids are put together by the numbers' places.

So what moves is the numbers (a byte or two for a word) and each gathering's distinct words, never the texts. The other columns of a row move with its
numbers. A lost executor costs its tasks. Models for which the condition does not hold (pieces across markers, other
normalizers, user-defined symbols, no dummy prefix) are encoded text by text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import tidy
from cadenza.llm.packed import CELL, cells, each_key, met, pack, pack_pair, pack_strings, steps, unpack, unpack_pair, unpack_strings

MARK = "▁"


def separable(model: bytes) -> bool:
    """Whether words can be segmented on their own: no piece has a marker after another character."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model)
    n = m.normalizer_spec
    plain = n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not n.precompiled_charsmap
    suffix = m.trainer_spec.treat_whitespace_as_suffix
    kinds = m.SentencePiece
    odd = any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) or re.search(f"[^{MARK}]{MARK}", p.piece) for p in m.pieces)
    marked = any(p.piece == MARK and p.type == kinds.NORMAL for p in m.pieces)
    return bool(marked and plain and not suffix and m.trainer_spec.model_type == pb.TrainerSpec.BPE and not odd)


def _pack(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class Codec:
    """The library in one Python worker, and what it makes of single words."""

    def __init__(self, model: bytes, bos: bool = True, eos: bool = True):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.head, self.tail = _pack([self.sp.bos_id()] if bos else []), _pack([self.sp.eos_id()] if eos else [])
        self.lone = [self.sp.piece_to_id(MARK)]  # a last marker with nothing after it; as a text it would be empty

    def words(self, text: str) -> list[str]:
        """Marked words, in order."""
        return _WORD(MARK + text.replace(" ", MARK)) if text else []

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words."""
        # the library puts the first marker there itself; one thread, as a call with more starts them anew
        found = self.sp.encode([w[1:] for w in words], num_threads=1)
        return [self.lone if w == MARK else ids for w, ids in zip(words, found, strict=True)]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.head + _pack(self.sp.encode(text or "")) + self.tail

    def decode(self, ids: bytes | None) -> str:
        return self.sp.decode(np.frombuffer(ids or b"", dtype="<u4").tolist())


_WORD = re.compile(f"{MARK}+[^{MARK}]*").findall
#: Bytes of text that a task gathers, and that a shard of words stands for.
GATHER, SHARD = 32 << 20, 8 << 20


def _gathered(docs: DataFrame, model, text: str, rest: list[str], shards: int) -> DataFrame:
    """To each shard the words of a gathering it has (kind 1), and by way of one of them the gathering itself (kind 2): other columns and numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        tables: list[pa.RecordBatch] = []
        number: dict[str, int] = {}
        marks: list[np.ndarray] = []
        size = 0

        def rows() -> list:
            flat = np.concatenate([np.empty(0, np.uint32), *marks])
            lengths = np.array([len(m) for m in marks], np.uint64)
            words = list(number)
            marks.clear()
            number.clear()  # the largest things here go as soon as they can
            # frequent words get small numbers, from 1 on; those met once come last, in order of their places, and so need no number but 0
            count = np.bincount(flat, minlength=len(words))
            order = np.argsort(-count, kind="stable")
            place = np.empty(len(words), np.uint64)
            place[order] = np.arange(1, len(words) + 1, dtype=np.uint64)
            place[count == 1] = 0
            raw = [words[i].encode("utf-8", "surrogatepass") for i in order.tolist()]
            del words
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, tables[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for t in tables:
                    w.write_batch(t)
            numbers, columns = pack(lengths, place[flat]), out.getvalue().to_pybytes()
            body = pack_pair(numbers, columns)
            name = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)
            cut: list[list[int]] = [[] for _ in range(shards)]
            for i, w in enumerate(raw):
                cut[zlib.crc32(w) % shards].append(i)
            asked = [(s, 1, name, pack_pair(pack(steps(np.array(own, np.uint64) + np.uint64(1))), pack_strings([raw[i] for i in own]))) for s, own in enumerate(cut) if own]
            tables.clear()
            return [(name % shards, 2, name, body), *asked]

        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                tables.append(b.select(rest))
                for t in b.column(text).to_pylist():
                    words = codec.words(t or "")
                    for w in words:
                        if w not in number:
                            number[w] = len(number)
                    marks.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                    size += len(t or "") + 16
                if size >= GATHER:
                    size = 0
                    yield cells(rows())
        if marks:
            yield cells(rows())
        del codec
        tidy()

    return docs.mapInArrow(run, CELL)


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids", bos: bool = True, eos: bool = True, decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``out``: binary, the text's ids as little-endian unsigned 32-bit integers.

    With ``decoded``, a second new column has what decode(ids) gives. Null and empty texts have the begin and end ids
    only and decode to the empty text. Columns of the same names are replaced, all others stay (the text only if ``keep_text``: it moves with them); every row
    gives one row, repeated rows and ties included; an empty table gives an empty one. A task that is run again must meet the same rows in the same
    order, as it does with tables.
    """
    with open(model_path, "rb") as f:
        raw = f.read()
    model = docs.sparkSession.sparkContext.broadcast(raw)  # a vocabulary file: below 1 MB here, whatever the data
    rest = [c for c in docs.columns if c not in (out, decoded) and (keep_text or c != text)]
    made = [F.lit(None).cast("binary").alias(out), *([F.lit(None).cast("string").alias(decoded)] if decoded else [])]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest], *made).schema
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c in rest or c == text])

    def told(codec: Codec, columns: list, ids: list[bytes]) -> pa.RecordBatch:
        more = [pa.array(ids, pa.binary())] + ([pa.array(map(codec.decode, ids), pa.string())] if decoded else [])
        return pa.RecordBatch.from_arrays([*columns, *more], names=[*rest, *[out, decoded][: len(more)]])

    if not separable(raw):

        def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = Codec(model.value, bos, eos)
            for whole in batches:
                for at in range(0, max(whole.num_rows, 1), 128):
                    b = whole.slice(at, 128)
                    yield told(codec, [b.column(c) for c in rest], list(map(codec.encode, b.column(text).to_pylist())))
            del codec
            tidy()

        return docs.mapInArrow(one_by_one, schema)

    shards = max(1, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // SHARD))

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for _, t in each_key(batches):
            known: dict[bytes, list[int]] = {}
            for kind, name, data in zip(t.column("kind").to_pylist(), t.column("owner").to_pylist(), t.column("data").to_pylist(), strict=True):
                if kind == 2:
                    yield cells([(0, 1, name, data)])
                    continue
                places, words = unpack_pair(data)
                words = unpack_strings(words)
                new = [w for w in words if w not in known]
                known.update(zip(new, codec.segment([w.decode("utf-8", "surrogatepass") for w in new]), strict=True))
                ids = [known[w] for w in words]
                flat = np.fromiter((x for i in ids for x in i), np.uint64)
                yield cells([(0, 0, name, pack(unpack(places)[0], np.array([len(i) for i in ids], np.uint64), flat))])
        del codec
        tidy()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value, bos, eos)
        for _, t in each_key(batches, "owner"):
            table: dict[int, bytes] = {}
            for kind, data in zip(t.column("kind").to_pylist(), t.column("data").to_pylist(), strict=True):
                if kind == 0:
                    places, lengths, flat = unpack(data)
                    raw_ids, edge = flat.astype("<u4").tobytes(), (4 * np.concatenate(([0], np.cumsum(lengths)))).astype(np.int64).tolist()
                    table.update(zip(np.cumsum(places).tolist(), (raw_ids[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)), strict=True))
                    continue
                body, columns = unpack_pair(data)
                lengths, numbers = unpack(body)
                once = np.flatnonzero(numbers == 0)
                numbers[once] = len(table) - len(once) + 1 + np.arange(len(once), dtype=np.uint64)
                edge, at = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64).tolist(), 0
                for b in pa.ipc.open_stream(columns):
                    ids = [codec.head + b"".join(map(table.__getitem__, numbers[edge[i] : edge[i + 1]].tolist())) + codec.tail for i in range(at, at + b.num_rows)]
                    at += b.num_rows
                    yield told(codec, list(b.columns), ids)
        del codec
        tidy()

    return met(met(_gathered(docs, model, text, rest, shards), segment, CELL), join, schema, "owner")


def decode(docs: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``: the text that packed ``ids`` stand for (null ids: empty).

    A column called as ``out`` is replaced, all others stay; every row gives one row; an empty table gives an empty one.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    rest = docs.drop(out)
    schema = rest.select("*", F.lit(None).cast("string").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(codec.decode, b.column(ids).to_pylist()), pa.string())], names=[*b.schema.names, out])

    return rest.mapInArrow(run, schema)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    both = encode(docs.select("doc_id", "text"), model_path, decoded="decoded", keep_text=False)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
