"""WARC archives, one Zstandard frame a record, with a dictionary in a leading skippable frame.

Layout of a file (.warc.zst): a skippable frame of magic 0x184D2A5D that holds the
dictionary, itself compressed or not; then a ``warcinfo`` record; then a record a frame.

Writing: payloads are compared by SHA-1 in a grouped minimum over digests alone.  Tasks write
files of their own rows, under names that no other attempt uses, into a folder
that all machines share, and return what they wrote; the table of these rows is the list of
the archives.  An attempt that is lost leaves files that no list names, and is run again.

Reading: a task opens one file at a time as a stream and holds one record; each frame is
decoded alone and its headers, lengths and digests are held against each other.
Paths are opened by ``pyarrow.fs``: local and mounted folders, and the stores that it knows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, gone_at_end, shared_dir, written

# fixed values of the formats
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSIONS = ("WARC/1.0", "WARC/1.1")
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

#: a new file is begun after this many bytes
ROLL_BYTES = 64 << 20
#: the dictionary of a task's files is fitted on its first records, at most so many and so many bytes
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 2 << 20, 32 << 10
#: digests with more than 1 / HOT of all rows, of which there are fewer than HOT, are broadcast
HOT = 50_000
CHUNK = 1 << 18
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that is not what its format asks for."""


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hex digits make four of base 32."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), *BASE32)


# --- ids of records ---------------------------------------------------------------------------------------------------


def record_id(row_id: int | None, digest: str, revisit: bool) -> str:
    """``urn:uuid`` (version 8) of a row: 48 bits of its payload's digest, its kind, and the 64 bits of its id.

    The same for rows that agree in all three."""
    bits = (row_id or 0) & (2**64 - 1)
    flags = (row_id is None) << 11 | revisit << 10 | bits >> 62
    head = int.from_bytes(base64.b32decode(digest)[:6], "big")
    return f"<urn:uuid:{uuid.UUID(int=head << 80 | 8 << 76 | flags << 64 | 2 << 62 | bits & (2**62 - 1))}>"


def row_id(name: Column) -> Column:
    """The row's id in a record's id; null where it had none."""
    digits = F.replace(F.regexp_extract(name, "urn:uuid:([0-9a-f-]{36})", 1), F.lit("-"), F.lit(""))
    part = lambda start, n: F.conv(F.substring(digits, start, n), 16, 10).cast("long")
    bits = lambda x, n: x.bitwiseAND(F.lit(n))
    whole = F.shiftleft(bits(part(16, 1), 3), 62).bitwiseOR(F.shiftleft(bits(part(17, 1), 3), 60)).bitwiseOR(part(18, 15))
    return F.when((F.length(digits) == 32) & (bits(part(14, 1), 8) == 0), whole)


# --- one record -------------------------------------------------------------------------------------------------------


@dataclass
class Record:
    """A record as read: ``payload`` is what follows the HTTP headers of the block, or the block."""

    version: str
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""

    @property
    def type(self) -> str:
        return self.headers["warc-type"]


def _digest(content: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()


def build_record(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """The bytes of a record; its length and the block's digest are added."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"WARC-Block-Digest: {_digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(key: int | None, url: str | None, payload: bytes | None, digest: str, size: int, keeper: tuple[int | None] | None) -> bytes:
    """A page as response, or, with ``keeper`` (the id of the row it repeats), as revisit, whose block is the HTTP headers alone."""
    revisit = keeper is not None
    name = record_id(key, digest, revisit)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or name[1:-1]
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(keeper[0], digest, False))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return build_record(headers, http if revisit else http + (payload or b""))


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header lines as a dict with lower-case names; a line that begins with white space goes on with the one before."""
    found: dict[str, str] = {}
    last = None
    for line in lines:
        text = line.decode("utf-8", "strict")
        if text[:1] in (" ", "\t") and last:
            found[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+\-.^_`|~0-9A-Za-z]+", name):
            raise WarcError(f"not a header: {text[:80]!r}")
        last = name.lower()
        if last in found and last != "warc-concurrent-to":
            raise WarcError(f"{name} is given twice")
        found[last] = value.strip()
    return found


def parse_record(raw: bytes) -> Record:
    """The record that fills ``raw``, validated; WarcError says what is wrong with it."""
    head, end, rest = raw.partition(b"\r\n\r\n")
    if not end:
        raise WarcError("headers without an end")
    first, *lines = head.split(b"\r\n")
    version = first.decode("latin-1")
    if version not in VERSIONS:
        raise WarcError(f"not a version: {version[:40]!r}")
    try:
        headers = _fields(lines)
    except UnicodeDecodeError as error:
        raise WarcError("headers are not UTF-8") from error
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(name):
            raise WarcError(f"no {name}")
    if headers["warc-type"] not in TYPES:
        raise WarcError(f"not a type: {headers['warc-type'][:40]!r}")
    if not re.fullmatch(r"<[A-Za-z][A-Za-z0-9+.-]*:[^<>\s]+>", headers["warc-record-id"]):
        raise WarcError("warc-record-id is no URI")
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z", headers["warc-date"]):
        raise WarcError("warc-date is no time")
    if not re.fullmatch("[0-9]+", headers["content-length"]):
        raise WarcError("content-length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"content-length is {size}, the block has {len(rest) - 4} bytes or another end")
    record = Record(version, headers, rest[:size])
    if (given := headers.get("warc-block-digest", "")).startswith("sha1:") and given != _digest(record.block):
        raise WarcError("warc-block-digest differs from the block")
    record.payload = record.block
    if headers.get("content-type", "").replace(" ", "").startswith("application/http"):
        top, end, record.payload = record.block.partition(b"\r\n\r\n")
        if not end:
            raise WarcError("HTTP headers without an end")
        record.http = {k.strip().lower(): v.strip() for k, _, v in (line.decode("latin-1").partition(":") for line in top.split(b"\r\n")[1:])}
    if record.type == "revisit":
        if not headers.get("warc-profile"):
            raise WarcError("a revisit without warc-profile")
        if record.payload and record.http:
            raise WarcError("a revisit with a payload")
    elif record.type == "response":
        if (given := headers.get("warc-payload-digest", "")).startswith("sha1:") and given != _digest(record.payload):
            raise WarcError("warc-payload-digest differs from the payload")
        if "content-length" in record.http and "transfer-encoding" not in record.http and record.http["content-length"] != str(len(record.payload)):
            raise WarcError("the HTTP content-length differs from the payload")
    return record


# --- files ------------------------------------------------------------------------------------------------------------


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)


class ArchiveWriter:
    """Files of one task below ``folder``; ``closed`` has (path, records, bytes) of each."""

    def __init__(self, folder: str, samples: list[bytes], roll_bytes: int = ROLL_BYTES, level: int = 3):
        import zstandard

        self.folder, self.roll_bytes = folder, roll_bytes
        self.closed: list[tuple[str, int, int]] = []
        self.stream = None
        try:  # k and d as given: no search for better ones
            self.dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8, level=level)
        except zstandard.ZstdError:  # too few samples: a file without a dictionary
            self.dictionary = None
        options = {"level": level, "write_checksum": True, "write_content_size": True}
        self.compressor = zstandard.ZstdCompressor(**options, **({"dict_data": self.dictionary} if self.dictionary else {}))
        self.plain = zstandard.ZstdCompressor(level=level)

    def _begin(self) -> None:
        name = uuid.uuid4().hex
        self.path = f"{self.folder}/{name}.warc.zst"
        system, path = _open(self.path)
        self.stream, self.records, self.bytes = system.open_output_stream(path, compression=None), 0, 0
        if self.dictionary:
            content = self.plain.compress(self.dictionary.as_bytes())
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(hex=name)}>"), ("WARC-Date", DATE), ("WARC-Filename", f"{name}.warc.zst"), ("Content-Type", "application/warc-fields")]
        self._put(self.compressor.compress(build_record(info, b"format: WARC File Format 1.1\r\n")))

    def _put(self, content: bytes) -> None:
        self.stream.write(content)
        self.bytes += len(content)

    def write(self, record: bytes) -> None:
        if self.stream is None:
            self._begin()
        self._put(self.compressor.compress(record))
        self.records += 1
        if self.bytes >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.closed.append((self.path, self.records, self.bytes))
            self.stream = None


def read_frames(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each frame of a stream of compressed bytes, with the dictionary that leads it.

    Other skippable frames are passed over.  WarcError for anything else, an incomplete frame included."""
    import zstandard

    buffer, at, decompressor = b"", 0, None

    def fill(n: int) -> bool:
        nonlocal buffer
        parts, have = [buffer], len(buffer)
        while have < n and (more := stream.read(max(CHUNK, n - have))):
            parts.append(more)
            have += len(more)
        buffer = b"".join(parts)
        return have >= n

    while fill(1):
        if not fill(4):
            raise WarcError(f"at {at}: bytes after the last frame")
        magic = int.from_bytes(buffer[:4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = int.from_bytes(buffer[4:8], "little") if fill(8) else 0
            if not fill(8 + size):
                raise WarcError(f"at {at}: a skippable frame that ends early")
            content, buffer = buffer[8 : 8 + size], buffer[8 + size :]
            if magic == DICTIONARY_MAGIC and at == 0:
                try:
                    if content[:4] == FRAME_MAGIC:
                        content = zstandard.ZstdDecompressor().decompress(content, max_output_size=64 << 20)
                    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
                except zstandard.ZstdError as error:
                    raise WarcError(f"at 0: no dictionary: {error}") from error
            at += 8 + size
            continue
        if buffer[:4] != FRAME_MAGIC:
            raise WarcError(f"at {at}: no frame")
        decompressor = decompressor or zstandard.ZstdDecompressor()
        frame, out, used = decompressor.decompressobj(), [], 0
        try:
            while True:
                out.append(frame.decompress(buffer))
                used += len(buffer)
                if frame.eof:
                    buffer = frame.unused_data
                    break
                if not (buffer := stream.read(CHUNK)):
                    raise WarcError(f"at {at}: a frame that ends early")
        except zstandard.ZstdError as error:
            raise WarcError(f"at {at}: {error}") from error
        yield at, b"".join(out)
        at += used - len(buffer)


def read_archive(path: str) -> Iterator[tuple[int, Record]]:
    """(offset, record) of each record of a file."""
    system, name = _open(path)
    with system.open_input_stream(name, compression=None) as stream:  # else the ending decides
        for at, content in read_frames(stream):
            try:
                yield at, parse_record(content)
            except WarcError as error:
                raise WarcError(f"at {at}: {error}") from error


# --- tables -----------------------------------------------------------------------------------------------------------


def keyed_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``(id, url, payload, size, digest)``: the payload in UTF-8, a null one empty."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return rows.select("id", "url", "payload", F.length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("digest"))


def with_keepers(rows: DataFrame, least_bytes: int = 0, hot: int = HOT) -> DataFrame:
    """``rows`` with ``keeper``: null for responses, else a struct with the id of the response that a row repeats.

    The response of a payload of ``least_bytes`` or more is its row with the smallest id, nulls last;
    rows that share that id are all responses.  Only payloads that repeat are looked up: those with more than 1 / ``hot``
    of the rows in a broadcast table of fewer than ``hot`` rows, the others in a join on the digest, where a key has at most 1 / ``hot``."""
    total = rows.count()
    same = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("kept"))
    same = written(same.where("n > 1"))
    frequent = F.col("n") > total / hot
    pick = lambda t, name: t.select(F.col("digest").alias("d"), F.struct("kept").alias(name))
    large = F.col("size") >= least_bytes
    found = rows.join(F.broadcast(pick(same.where(frequent), "hot")), (F.col("digest") == F.col("d")) & large, "left").drop("d")
    # rows that are settled get keys of their own, so that they are dealt out evenly
    key = F.when(large & F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string")))
    found = found.withColumn("key", key).join(pick(same.where(~frequent), "cold"), F.col("key") == F.col("d"), "left").drop("d", "key")
    kept = F.coalesce("hot", "cold")
    return found.withColumn("keeper", F.when(kept.isNotNull() & ~F.col("id").eqNullSafe(kept["kept"]), kept)).drop("hot", "cold")


def write_archives(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes a record for each row of ``pages`` and returns the list of archives, ``(path, records, bytes)``.

    ``folder`` is one that all machines share; without it, one below the checkpoint folder is taken, which goes when the driver ends.  A page is
    the ``response`` of its payload or, for payloads of ``least_bytes`` or more, a ``revisit`` of the row with the smallest id and the same payload.
    A null payload is empty; a null url gives the record's own id as its target, white space in a url is percent-encoded; a null id is kept as such;
    repeated rows are written each; other columns are not read; an empty table gives an empty list."""
    spark = pages.sparkSession
    bound_batches(spark)
    own, folder = folder is None, folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    if own:
        gone_at_end(spark, folder)
    rows = with_keepers(keyed_pages(pages, id_col=id_col, url_col=url_col, payload_col=payload_col), least_bytes)
    first = F.col("keeper").isNull()
    rows = rows.select("id", "url", F.when(first, F.col("payload")).alias("payload"), "digest", "size", (~first).alias("again"), F.col("keeper.kept").alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        writer, size = None, 0
        for batch in batches:
            for key, url, payload, digest, n, again, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = page_record(key, url, payload, digest, n, (kept,) if again else None)
                if writer:
                    writer.write(record)
                    continue
                held.append(record)
                size += len(record)
                if len(held) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
                    writer, held = _started(folder, held, roll_bytes), []
        if held:
            writer = _started(folder, held, roll_bytes)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*writer.closed, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return written(rows.mapInArrow(run, "path string, records long, bytes long"))


def _started(folder: str, held: list[bytes], roll_bytes: int) -> ArchiveWriter:
    writer = ArchiveWriter(folder, [r[:SAMPLE_BYTES] for r in held], roll_bytes)
    for record in held:
        writer.write(record)
    return writer


RECORDS = pa.schema(
    [
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("date", pa.string()),
        ("target_uri", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("refers_to", pa.string()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
        ("problem", pa.string()),
    ]
)
_DDL = "path string, offset long, record_type string, record_id string, date string, target_uri string, payload_digest string, payload_bytes long, refers_to string, headers map<string,string>, payload binary, problem string"


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``(path)`` of the archives in a folder; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")


def read_archives(files: DataFrame, *, payload: bool = True, strict: bool = True) -> DataFrame:
    """A row for each record of the archives named by ``files.path``, with the columns of ``RECORDS``.

    Names of headers are in lower case; ``payload_digest`` is bare where it is a SHA-1; ``payload_bytes`` is the size of the full payload, for a
    revisit as its HTTP headers state it (null where they don't).  ``payload=False`` leaves the payload null, after it was checked.
    An archive that breaks the rules stops the query with WarcError, or, with ``strict=False``, gives the records before the fault and a row whose
    ``problem`` says what it is: frames have no marks from which a reader could go on.
    Null paths are passed over, a path given twice is read twice, an empty list gives no rows, an empty file no records; other columns are not read."""
    files = files.select("path").where("path IS NOT NULL")
    bound_batches(files.sparkSession)

    def rows(path: str) -> Iterator[tuple]:
        try:
            for at, r in read_archive(path):
                h, size = r.headers, len(r.payload)
                if r.type == "revisit":
                    stated = r.http.get("content-length", "")
                    size = int(stated) if re.fullmatch("[0-9]{1,18}", stated) else None
                yield path, at, r.type, h["warc-record-id"], h["warc-date"], h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, size, h.get("warc-refers-to"), list(h.items()), r.payload if payload else None, None
        except WarcError as error:
            if strict:
                raise WarcError(f"{path}, {error}") from error
            yield path, *[None] * 10, str(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), RECORDS.types, strict=True)], schema=RECORDS)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    held.append(row)
                    size += 500 + len(row[10] or b"")
                    if size >= 4 << 20:
                        yield give()
                        held, size = [], 0
        if held:
            yield give()

    return files.repartition(max(1, min(files.count(), 10_000))).mapInArrow(run, _DDL)
