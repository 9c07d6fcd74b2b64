"""Web archives (WARC 1.1, one gzip member a record), written and read as a Spark source.

``df.write.format("warc")`` writes archives, ``spark.read.format("warc")`` reads them
split. A file is dealt out in byte ranges. A task looks for the gzip magic in its range,
takes a place for a member only if its first bytes decode to a WARC header, and from
there goes from member to member; it owns the records that *start* in its range and
reads past the end of the range to finish the last of them. So every record has exactly
one owner, whatever the ranges are, and nothing has to be listed beforehand.

Inside a range a member must begin where the one before it ends. If none does, the
archive is damaged there: the read fails, or with the option ``mode`` = ``permissive``
gives a row with ``error`` set and goes on at the next member. A payload that was stored
uncompressed and is an archive itself can hold whole members; ``unchained`` finds
records taken from inside another, by the borders of all records.

Writing: every attempt of a task writes files of its own below ``_attempts``; the commit
moves those of the successful ones, so a lost executor leaves no half archive behind.
Files are reached through pyarrow's file systems (local and shared folders, HDFS, S3,
GCS).

Definitions for odd input: a null payload is empty; a null or empty url has no target
field; line breaks and other control characters of a url are percent-encoded; a null
page_id is the id ``null``; repeated rows are a record each, all of them responses if
their page_id is the largest of the payload; a page without id is a revisit of one that
has an id; an empty table gives an archive folder without archives, which reads as no
rows; columns beside page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tochi.llm.common import BATCH_BYTES, BATCH_ROWS, saved, shared_dir, small_batches, table, with_facts

MAGIC = b"\x1f\x8b\x08"
#: Bytes read at once, and fed to the decoder at once.
BLOCK, FEED = 1 << 20, 1 << 14
#: Bytes of a range, and of an archive before the next one is begun.
SPLIT_BYTES, ARCHIVE_BYTES = 32 << 20, 1 << 30
#: Payloads shorter than this are stored at every occurrence.
LEAST_SHARED = 1000

SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("stop", T.LongType()),
        T.StructField("warc_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("warc_date", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("http_headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
WRITE_COLUMNS = ("warc_type", "record_id", "target_uri", "warc_date", "refers_to", "payload", "payload_bytes", "payload_digest")

_control = re.compile(r"[\x00-\x20\x7f-\x9f]")


class Damaged(ValueError):
    """A place of an archive that should be a record and is none."""


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Window:
    """A file read forwards in blocks, of which those behind the reader are dropped."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.base, self.held = file, size, 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes at ``at``; fewer only at the end of the file."""
        if not self.base <= at <= self.base + len(self.held):
            self.base, self.held = at, b""
        short = at + n - self.base - len(self.held)
        if short > 0 and self.base + len(self.held) < self.size:
            self.file.seek(self.base + len(self.held))
            more = self.file.read(max(short, BLOCK))
            self.held, self.base = self.held[at - self.base :] + more, at
        return self.held[at - self.base : at - self.base + n]

    def find_magic(self, at: int, stop: int) -> int | None:
        """The first magic that starts at ``at`` or behind it, and before ``stop``."""
        while at < stop:
            some = self.bytes(at, min(BLOCK, stop - at + len(MAGIC) - 1))
            found = some.find(MAGIC)
            if found >= 0:
                return at + found
            if len(some) < len(MAGIC):
                return None
            at += len(some) - len(MAGIC) + 1
        return None

    def member(self, at: int) -> tuple[bytes, int] | None:
        """What the gzip member at ``at`` holds and where it ends; None if no WARC record starts there."""
        decoder, parts, began = zlib.decompressobj(31), [], at
        head, told = b"", False
        while True:
            fed = self.bytes(at, FEED)
            try:
                parts.append(decoder.decompress(fed))
            except zlib.error as e:
                if not told:
                    return None
                raise Damaged(f"member at {began}: {e}") from e
            if not told:
                head += parts[-1]
                told = len(head) >= 5
                if told and not head.startswith(b"WARC/"):
                    return None
            if decoder.eof:
                return (b"".join(parts), at + len(fed) - len(decoder.unused_data)) if told else None
            at += len(fed)
            if not fed:
                if not told:
                    return None
                raise Damaged(f"member at {began}: the file ends inside it")


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with white space continues the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if colon and name:
            out[name] = value.strip()
    return out


def _digest_of(field: str | None) -> str | None:
    """Lower-case hex of a ``sha1:`` field in base 32 or hex."""
    value = (field or "").removeprefix("sha1:")
    if len(value) == 40:
        return value.lower()
    return base64.b32decode(value).hex() if re.fullmatch("[A-Z2-7]{32}", value) else None


def records_in(content: bytes) -> Iterator[dict]:
    """The records of one decoded member."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        lines = content[at:end].split(b"\r\n")
        headers = _fields(lines[1:])
        length = headers.get("content-length", "")
        if end < 0 or not lines[0].startswith(b"WARC/") or not length.isascii() or not length.isdigit():
            raise Damaged("no WARC header")
        stop = end + 4 + int(length)
        if stop > len(content):
            raise Damaged("the block is shorter than its length")
        block, http = content[end + 4 : stop], None
        if headers.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            head = block if cut < 0 else block[:cut]
            http, block = _fields(head.split(b"\r\n")[1:]), b"" if cut < 0 else block[cut + 4 :]
        kind = headers.get("warc-type")
        record = {"warc_type": kind, "record_id": headers.get("warc-record-id"), "target_uri": headers.get("warc-target-uri"), "warc_date": headers.get("warc-date"), "refers_to": headers.get("warc-refers-to"), "headers": headers, "http_headers": http, "payload": block, "payload_bytes": len(block)}
        if kind == "revisit":  # its payload is that of another record
            size = (http or {}).get("content-length", "")
            record |= {"payload": None, "payload_bytes": int(size) if size.isascii() and size.isdigit() else None, "payload_digest": _digest_of(headers.get("warc-payload-digest"))}
        yield record
        at = stop + 4 if content[stop : stop + 4] == b"\r\n\r\n" else stop


def scan(file, size: int, start: int, stop: int, permissive: bool = False) -> Iterator[dict]:
    """The records whose member starts in [start, stop), in order, with ``start`` and ``stop`` of their member."""
    window = Window(file, size)
    at, chained = start, start == 0
    while at < min(stop, size):
        if chained:
            pad = window.bytes(at, FEED)
            if not pad.strip(b"\0"):  # zeros behind a member are padding
                at += len(pad)
                continue
            at += len(pad) - len(pad.lstrip(b"\0"))
            if at >= stop:
                return
        else:
            found = window.find_magic(at, stop)
            if found is None:
                return
            at = found
        try:
            member = window.member(at)
            if member is None and chained:
                raise Damaged(f"no member at {at}")
            own = list(records_in(member[0])) if member else []
        except Damaged as e:
            if not permissive:
                raise
            yield {"start": at, "stop": at + 1, "error": str(e)}
            at, chained = at + 1, False
            continue
        if member is None:
            at += 1
            continue
        yield from (record | {"start": at, "stop": member[1]} for record in own)
        at, chained = member[1], True


class ByteRange(InputPartition):
    """Some bytes of an archive."""

    def __init__(self, path: str, size: int, start: int, stop: int) -> None:
        self.path, self.size, self.start, self.stop = path, size, start, stop


class WarcReader(DataSourceReader):
    """Rows of the asked columns; a payload is kept only if it is asked for."""

    def __init__(self, schema: T.StructType, options: dict) -> None:
        unknown = [f.name for f in schema if f.name not in SCHEMA.fieldNames()]
        if unknown:
            raise ValueError(f"the warc source has no columns {unknown}")
        self.names = schema.fieldNames()
        self.root, self.permissive = options["path"], options.get("mode", "failfast").lower() == "permissive"
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[ByteRange]:
        from pyarrow import fs

        store, root = _store(self.root)
        found = store.get_file_info(fs.FileSelector(root)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".warc.gz"))
        return [ByteRange(path, size, at, min(at + self.split_bytes, size)) for path, size in files for at in range(0, size, self.split_bytes)] or [ByteRange("", 0, 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(T.StructType([SCHEMA[n] for n in self.names]))
        if not part.size:
            return
        with _store(self.root)[0].open_input_file(part.path) as file:
            rows, held = [], 0
            for record in scan(file, part.size, part.start, part.stop, self.permissive):
                record["path"] = part.path
                payload = record.get("payload")
                if payload is not None and "payload_digest" in self.names:
                    record["payload_digest"] = hashlib.sha1(payload).hexdigest()
                rows.append(tuple(record.get(n) for n in self.names))
                held += len(payload or b"") if "payload" in self.names else 100
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield _batch(rows, kind)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, kind)


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kind)], schema=kind)


def _encoded(text: str) -> str:
    return _control.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def record_bytes(row: dict) -> bytes:
    """One record, uncompressed: HTTP message of a response, HTTP head alone of a revisit, or the payload itself."""
    payload, kind = row["payload"] or b"", row["warc_type"]
    http = b""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["warc_date"])]
    if row["target_uri"]:
        fields.append(("WARC-Target-URI", _encoded(row["target_uri"])))
    if kind in ("response", "revisit"):
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
        fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()))
        fields.append(("Content-Type", "application/http; msgtype=response"))
    else:
        fields.append(("Content-Type", "application/warc-fields" if kind == "warcinfo" else "application/octet-stream"))
    if kind == "revisit":
        payload = b""
        fields += [("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(http) + len(payload))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + http + payload + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    """The archives that an attempt of a task has closed."""

    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """A gzip member a row; archives are closed beyond a size."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool) -> None:
        missing = set(WRITE_COLUMNS) - set(schema.fieldNames())
        if missing:
            raise ValueError(f"the warc source needs the columns {sorted(missing)}")
        self.root, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex[:12]
        self.level, self.most = int(options.get("level", 6)), int(options.get("archiveBytes", ARCHIVE_BYTES))

    def _pack(self, record: bytes) -> bytes:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        return packer.compress(record) + packer.flush()

    def _info(self, name: str) -> bytes:
        return self._pack(record_bytes({"warc_type": "warcinfo", "record_id": f"urn:archive:{name}", "warc_date": "1970-01-01T00:00:00Z", "target_uri": None, "payload": b"format: WARC File Format 1.1\r\n"}))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.root)
        attempt, files, out = uuid.uuid4().hex, [], None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in WRITE_COLUMNS]
            for i in range(batch.num_rows):
                if out is None:
                    store.create_dir(f"{root}/_attempts", recursive=True)
                    files.append(f"{root}/_attempts/{attempt}-{len(files):04d}.warc.gz")
                    out = store.open_output_stream(files[-1], compression=None)
                    out.write(self._info(files[-1].rpartition("/")[2]))
                out.write(self._pack(record_bytes({n: c[i].as_py() for n, c in zip(WRITE_COLUMNS, columns)})))
                if out.tell() >= self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.root)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.type == fs.FileType.File:
                    store.delete_file(f.path)
        for k, path in enumerate(f for m in messages if m for f in m.files):
            store.move(path, f"{root}/{self.job}-{k:05d}.warc.gz")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.root)
        if store.get_file_info(f"{root}/_attempts").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_attempts")


class WarcSource(DataSource):
    """``warc``: options path, splitBytes, mode (failfast, permissive); for writing level and archiveBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(schema, self.options, overwrite)


def unchained(records: DataFrame) -> DataFrame:
    """(path, start) of records that begin neither at the start of their archive nor where another ends.

    Empty for a sound archive without padding. A row is the first record of a nested
    archive, or of what follows damage.
    """
    starts, stops = records.select("path", "start").distinct(), records.select("path", F.col("stop").alias("start")).distinct()
    return starts.filter("start > 0").join(stops, ["path", "start"], "left_anti")


def records_of(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The records of pages: equal payloads from LEAST_SHARED bytes on are stored once.

    Payloads are the same if SHA-1, a second hash and the length agree. Sums a payload
    are formed before anything is shuffled, and payloads that occur once are not joined.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("target_uri"), payload.alias("payload")).withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    shared = F.when(F.col("payload_bytes") >= LEAST_SHARED, F.concat_ws(" ", "payload_digest", F.xxhash64("payload").cast("string"), "payload_bytes"))
    rows = rows.withColumn("content", shared)
    groups = rows.filter("content is not null").groupBy("content").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).filter("copies > 1")
    rows = with_facts(rows, saved(groups, "warc-groups"), "content", "copies")
    response = F.col("copies").isNull() | F.col("page_id").eqNullSafe(F.col("keeper"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.url_encode(F.col(c).cast("string")), F.lit("null")))
    return rows.select(
        F.when(response, "response").otherwise("revisit").alias("warc_type"),
        urn("page_id").alias("record_id"),
        "target_uri",
        F.lit(date).alias("warc_date"),
        F.when(~response, urn("keeper")).alias("refers_to"),
        F.when(response, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
    )


def write(records: DataFrame, path: str) -> None:
    """Records as archives in a folder."""
    records.sparkSession.dataSource.register(WarcSource)
    small_batches(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, **options: object) -> DataFrame:
    """Records of archives; ``columns`` says which, so that payloads need not leave the reader."""
    spark.dataSource.register(WarcSource)
    kind = T.StructType([SCHEMA[c] for c in columns]) if columns else SCHEMA
    return spark.read.format("warc").schema(kind).options(**options).load(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: pages written as archives and read back by byte ranges."""
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(records_of(pages), path)
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    rows = read(spark, path, ["warc_type", "record_id", "refers_to", "payload_bytes", "payload_digest"], splitBytes=split)
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.nullif(F.url_decode(F.regexp_extract(c, "^<urn:page:(.*)>$", 1)), F.lit("null")).cast(kind)
    kept = rows.filter(F.col("warc_type").isin("response", "revisit"))
    return kept.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.when(F.col("refers_to").isNotNull(), page("refers_to")).alias("refers_to"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS keeper FROM p WHERE strlen(html) >= {LEAST_SHARED} GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.html IS NULL OR p.page_id IS NOT DISTINCT FROM g.keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.html IS NULL OR p.page_id IS NOT DISTINCT FROM g.keeper THEN NULL ELSE g.keeper END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html
"""
