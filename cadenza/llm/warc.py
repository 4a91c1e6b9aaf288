"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading: a file is a partition. Predicates on header columns (equality, IN, prefix) are pushed into the reader, which
parses a record's headers first; a record they refuse is skipped without decoding its block. Writing stores each record as
a gzip member with the `sl` skip-length field, so a reader can jump over a refused member without inflating it; archives
without the field, and plain .warc files, are read as well. Payloads are decoded only if the read schema has ``payload``: without it,
inflating ends with the HTTP head that tells the payload's length.

Writers fill a file under a name of the attempt and the commit renames it, so a lost executor or a repeated task leaves no
second copy. Names hold a number of the job, so a folder takes any number of appends; a commit that meets a file of its name, or
fails halfway, takes back what it has moved. Paths are opened by pyarrow's file systems (file:, hdfs:, s3:, gs:), never through a local temporary folder.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from cadenza.llm.common import fits, helper, saved, tidy

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_length long, headers map<string,string>, payload binary"
#: Columns read from one header each.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}
BREAK = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def to_hex(digest: str | None) -> str | None:
    """Lower-case hex of a WARC digest value (`sha1:` and base32 or hex)."""
    if not digest:
        return None
    value = digest.rpartition(":")[2]
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


def to_labelled(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def _clean(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


def record(row: dict) -> bytes:
    """A WARC/1.1 record. Revisits have the HTTP head, whose Content-Length tells the full payload's size, and no payload."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {row.get('content_type') or 'text/html; charset=utf-8'}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row.get("date")), ("WARC-Target-URI", row.get("target_uri"))]
    head += [("WARC-Payload-Digest", to_labelled(row["payload_digest"])), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{row['refers_to']}>" if row["refers_to"] else None)]
    head += [("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block + BREAK


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with its length in an `sl` extra field (left out where it takes over 32 bits)."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    total = 24 + len(body)
    if total < 1 << 32 and len(data) < 1 << 32:
        return struct.pack("<BBBBIBB", 31, 139, 8, 4, 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data)) + body
    return struct.pack("<BBBBIBB", 31, 139, 8, 0, 0, 0, 255) + body


class _Input:
    """A file read ahead by ``size`` bytes, with jumps."""

    def __init__(self, f, size: int = 1 << 20):
        self.f, self.size, self.buffer, self.at = f, size, b"", 0

    def need(self, n: int) -> bytes:
        """At least n bytes from here on, fewer at the end of the file."""
        if len(self.buffer) - self.at < n:
            have = self.buffer[self.at :]
            self.buffer, self.at = have + self.f.read(max(self.size, n - len(have))), 0
        return self.buffer[self.at : self.at + n]

    def skip(self, n: int) -> None:
        over = self.at + n - len(self.buffer)
        if over > 0:
            self.f.seek(over, 1)
            self.buffer, self.at = b"", 0
        else:
            self.at += n


def _member(src: _Input, wanted, whole: bool = True) -> tuple[bytes, bytes] | None | bool:
    """Next record of a gzip file as (WARC head, block), None if ``wanted(head)`` refuses it, False at the end.

    Unless ``whole``, the block may end after its HTTP head; a member that tells its length is then left there.
    """
    head = src.need(10)
    if len(head) < 10:
        return False
    if head[:3] != b"\x1f\x8b\x08":
        raise ValueError("not a gzip member")
    flags, total, n = head[3], None, 10
    if flags & 4:
        extra = struct.unpack("<H", src.need(12)[10:])[0]
        field = src.need(12 + extra)[12:]
        n = 12 + extra
        while len(field) >= 4:
            key, size = field[:2], struct.unpack("<H", field[2:4])[0]
            if key == b"sl" and size >= 8:
                total = struct.unpack("<I", field[4:8])[0]
            field = field[4 + size :]
    for bit in (8, 16):  # name, comment
        while flags & bit:
            n += 1
            if src.need(n)[-1:] in (b"\0", b""):
                break
    n += 2 if flags & 2 else 0
    z, out, at, refused, head = zlib.decompressobj(-15), bytearray(), n, False, b""
    src.need(n)
    src.skip(n)
    while not z.eof:
        chunk = src.need(1 << 16)
        if not chunk:
            raise ValueError("a gzip member is cut off")
        got = z.decompress(chunk, 0 if head and (whole or refused) else 8192)
        used = len(chunk) - len(z.unused_data if z.eof else z.unconsumed_tail)
        src.skip(used)
        at += used
        out += got
        if not head and (end := out.find(BREAK)) >= 0:
            head = bytes(out[: end + 4])
            refused = not wanted(head)
            del out[: end + 4]
            if refused and total:
                src.skip(total - at)
                return None
        if head and not refused and not whole and total and (end := out.find(BREAK)) >= 0:
            src.skip(total - at)
            return head, bytes(out[: end + 4])
        if refused:
            out.clear()
    src.skip(8)
    return None if refused else (head, bytes(out[:-4]) if out.endswith(BREAK) else bytes(out))


def _plain(src: _Input, wanted, whole: bool = True) -> tuple[bytes, bytes] | None | bool:
    """The same of a file that isn't compressed."""
    n = 8192
    while (end := (got := src.need(n)).find(BREAK)) < 0:
        if len(got) < n:
            return False
        n *= 2
    head = got[: end + 4]
    size = int(_parse(head).get("content-length", 0))
    src.skip(end + 4)
    block = src.need(size) if wanted(head) else None
    src.skip(size + 4)
    return None if block is None else (head, block)


def _parse(head: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _column(fields: dict[str, str], column: str) -> str | None:
    value = fields.get(HEADERS[column])
    return value.strip("<>") if value is not None and column in ("record_id", "refers_to") else value


@dataclass
class WarcFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema, batch: int = 512):
        self.path, self.fields, self.batch, self.pushed = path, [(f.name, f.dataType) for f in schema.fields], batch, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.pushed.append((f.attribute[0], "prefix" if isinstance(f, StringStartsWith) else "in", list(f.value) if isinstance(f, In) else [f.value]))
            else:
                yield f

    def partitions(self) -> list[WarcFile]:
        from pyarrow import fs

        files, root = _fs(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True)) if files.get_file_info(root).type == fs.FileType.Directory else [files.get_file_info(root)]
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else "file://"
        host = "" if scheme in ("file://",) else "/".join(self.path.partition("://")[2].split("/")[:1])
        names = sorted(x.path for x in found if x.path.endswith((".warc", ".warc.gz")) and x.size)
        # object stores give bucket/key, others a path from the root
        return [WarcFile(scheme + ("" if not n.startswith("/") else host) + n) for n in names]

    def wanted(self, head: bytes) -> bool:
        fields = _parse(head)
        for column, kind, values in self.pushed:
            got = _column(fields, column)
            if got is None or not (got.startswith(values[0]) if kind == "prefix" else got in values):
                return False
        return True

    def read(self, part: WarcFile | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([(n, to_arrow_type(t)) for n, t in self.fields])
        names, rows, size = [n for n, _ in self.fields], [], 0
        files, path = _fs(part.path)
        with files.open_input_file(path) as f:
            src = _Input(f)
            step, whole = _member if path.endswith(".gz") else _plain, "payload" in names
            while (got := step(src, self.wanted, whole)) is not False:
                if got is None:
                    continue
                rows.append(self.row(*got, names))
                size += len(got[1])
                if len(rows) >= self.batch or size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        tidy()

    def row(self, head: bytes, block: bytes, names: list[str]) -> dict:
        fields = _parse(head)
        out = {n: _column(fields, n) for n in names if n in HEADERS}
        http, found, payload = block.partition(BREAK)
        is_http = found and fields.get("content-type", "").startswith("application/http")
        if "payload_digest" in names:
            out["payload_digest"] = to_hex(fields.get("warc-payload-digest"))
        if "payload_length" in names:
            told = _parse(http).get("content-length") if is_http else None
            size = int(fields.get("content-length") or len(block))
            out["payload_length"] = int(told) if told else size - len(http) - len(BREAK) if is_http else size
        if "headers" in names:
            out["headers"] = list(fields.items())
        if "payload" in names:
            out["payload"] = None if fields.get("warc-type") == "revisit" else payload if is_http else block
        return out


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, max_bytes: int):
        self.path, self.max_bytes, self.job = path, max_bytes, uuid.uuid4().hex[:16]  # made on the driver, once for a job

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = _fs(self.path)
        files.create_dir(root, recursive=True)
        moves, out, size = [], None, 0
        try:
            for batch in batches:
                for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
                    if out is None or size >= self.max_bytes:
                        if out:
                            out.close()
                        name = f"{root}/part-{self.job}-{task.partitionId():05d}-{len(moves):04d}"
                        moves.append((f"{name}.{task.taskAttemptId()}.open", f"{name}.warc.gz"))
                        out, size = files.open_output_stream(moves[-1][0], compression=None), 0
                    size += out.write(data := member(record(row))) or len(data)
        finally:
            if out:
                out.close()
        tidy()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, _ = _fs(self.path)
        moves = [x for m in messages if m for x in m.moves]
        done: list[str] = []
        try:
            for old, new in moves:
                if files.get_file_info(new).type != fs.FileType.NotFound:
                    raise FileExistsError(new)
                files.move(old, new)
                done.append(new)
        except BaseException:
            for name in [*done, *(old for old, _ in moves[len(done) :])]:
                files.delete_file(name)
            raise

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _fs(self.path)
        for m in messages:
            for old, _ in m.moves if m else ():
                files.delete_file(old)


class WarcSource(DataSource):
    """Options: path; max_file_bytes (a writer starts a new file beyond it, 256 MB)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("max_file_bytes", 256 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def mark_revisits(records: DataFrame, key: str = "key", least: int = 1000) -> DataFrame:
    """``records`` (record_id, payload, long ``key``, ...) with payload_digest (hex SHA-1), record_type and refers_to.

    Of records with equal payloads of ``least`` bytes and more, the one with the largest key is the response and the
    others revisit it; smaller payloads are responses. Null payloads count as empty. Rows that share the largest key
    (repeated rows) are all responses; rows without a key revisit the largest key, and are responses if none has one. An empty
    table gives an empty result; columns of the new names are replaced, all others stay.

    Digests are counted first; only such as occur again come back to the payloads. They are broadcast while they have at most
    common.SMALL_BYTES, so no payload is shuffled; beyond that they are joined by a shuffle whose hot digests adaptive execution splits.
    """
    new = ("payload_digest", "record_type", "refers_to")
    rest = records.drop(*new)
    n = F.octet_length("payload")
    digest = F.when(n >= least, F.sha1("payload"))
    seen = rest.where(n >= least).select(digest.alias("d"), F.col(key).alias("k"), F.col("record_id").alias("r"))
    first = seen.groupBy("d").agg(F.max("k").alias("top"), F.max_by("r", "k").alias("first"), F.count("*").alias("c")).where("c > 1 and top is not null")
    first = saved(first.select("d", "top", "first"), "digests")
    small = fits(first, F.length("d") + F.coalesce(F.length("first"), F.lit(0)) + 64)
    row, own = helper(rest, "row"), rest.select(F.struct("*").alias("row"), digest.alias("d"))
    out = own.join(F.broadcast(first) if small else first, "d", "left")
    other = F.col("top").isNotNull() & ~F.col(f"row.`{key}`").eqNullSafe(F.col("top"))
    out = out.select(F.col("row").alias(row), F.when(other, "revisit").otherwise("response").alias("t"), F.when(other, F.col("first")).alias("f"))
    cells = [F.col(f"`{row}`.`{c}`").alias(c) for c in rest.columns if c != "payload"]
    full = F.coalesce(F.col(f"`{row}`.payload"), F.lit(b""))
    return out.select(*cells, full.alias("payload"), F.sha1(full).alias("payload_digest"), F.col("t").alias("record_type"), F.col("f").alias("refers_to"))


def write(records: DataFrame, path: str) -> None:
    """Archive ``records``: record_id, record_type, target_uri, date, payload_digest, refers_to, payload; other columns are left out, so their names can't clash.

    Files are added to those in ``path``. No rows, no archive. Nulls leave out their header (a null payload is an empty one); repeated rows are records of their own.
    """
    register(records.sparkSession)
    records.select("record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to", "payload").write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """The archives below ``path``, with those of the source's columns that the DDL in ``columns`` names."""
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


def archive_pages(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """A WARC record per row of ``pages`` (page_id, url, html); all other columns are left out."""
    records = pages.select(
        F.col("page_id").alias("key"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.col("html").cast("binary").alias("payload")
    )
    write(mark_revisits(records), path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: responses from the payloads read back, revisits from their headers.

    A row for each record of the archives, repeated ones as well; page_id is null where the record had none; an empty folder gives an empty result.
    """
    number = lambda c: F.nullif(F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1), F.lit("")).cast("long")
    full = read(spark, path, "record_id string, record_type string, payload binary").where("record_type = 'response'")
    full = full.select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read(spark, path, "record_id string, record_type string, payload_digest string, payload_length long, refers_to string").where("record_type = 'revisit'")
    return full.union(again.select(number("record_id"), "payload_length", "payload_digest", "record_type", number("refers_to")))
