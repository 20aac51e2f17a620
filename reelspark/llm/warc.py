"""WARC archives: one gzip member a record, read back in order.

The writer packs pages into archives in the shared folder; of equal payloads one
is stored and the others become revisits.  The reader inflates a member at a time
in bounded steps, frames its block by the content length and verifies digests.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Workspace, small_batches

#: Bytes read, and at most inflated, in one step.
STEP = 1 << 20
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 1 << 30
#: A record's header may have so many bytes.
HEADER_BYTES = 1 << 20
#: So many repeated payloads (41 bytes each) are broadcast; beyond it Spark shuffles.
BROADCAST_PAYLOADS = 400_000
RECORD_ID = "urn:x-page:"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "file string, records bigint, bytes bigint"
RECORDS = (
    "file string, offset bigint, record_id string, record_type string, target_uri string, refers_to string, block_bytes bigint,"
    " payload_bytes bigint, payload_digest string, declared_digest string, verified boolean, payload binary, error string"
)


# --- writing -----------------------------------------------------------------


def _member(headers: list[tuple[str, str]], parts: list[bytes], level: int) -> bytes:
    """A record as a gzip member: header, block, two line ends."""
    block = hashlib.sha256()
    for p in parts:
        block.update(p)
    headers = [*headers, ("WARC-Block-Digest", f"sha256:{block.hexdigest()}"), ("Content-Length", str(sum(map(len, parts))))]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = [pack.compress(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode())]
    out += [pack.compress(p) for p in parts] + [pack.compress(b"\r\n\r\n"), pack.flush()]
    return b"".join(out)


def _id(page: str | None) -> str:
    return uuid.uuid4().urn if page is None else RECORD_ID + urllib.parse.quote(page, safe="")


def _record(page: dict, date: str, level: int) -> bytes:
    """The member of a page: response with its payload, or revisit without."""
    payload = page["payload"]
    revisit = page["refers_to"] is not None
    # a line end in an address would end its header line
    uri = urllib.parse.quote(page["url"] or "", safe="".join(map(chr, range(0x21, 0x7F))))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['n_bytes']}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_id(page['page'])}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{page['digest']}"),
    ]
    if revisit:
        headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<{_id(page['refers_to'])}>")]
    return _member(headers, [http] if revisit else [http, payload], level)


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, work: Workspace, date: str | None = None, least: int = 100, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` as archives under ``folder`` and returns
    the manifest ``file, records, bytes``; only files of the manifest count.

    ``folder`` is a URI that all machines reach (``file:`` on a shared disk, ``hdfs:``,
    ``s3:``, ``gs:``).  Each task streams its rows into archives of its own; a task
    that is lost and repeated leaves files that no manifest row names.  Of payloads
    (the text in UTF-8, null: empty) that are equal and have at least ``least`` bytes,
    that of the smallest ``page_id`` is a response, others revisit it; rows that
    repeat this id are responses too, as are all where no id is known.  A null id is
    larger than any other; a null address is empty.  Other columns are not read.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    src = pages.select(
        F.col("page_id").cast("string").alias("page"), F.col("page_id").alias("id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    )
    src = src.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("bigint")})
    groups = src.where(F.col("n_bytes") >= least).groupBy(F.unhex("digest").alias("key"), F.col("n_bytes").alias("size")).agg(F.min("id").alias("first"), F.count("*").alias("k"))
    repeated = work.table(groups.where("k > 1 and first is not null").select("key", "size", "first"))
    few = repeated.count() <= BROADCAST_PAYLOADS
    same = (F.unhex("digest") == F.col("key")) & (F.col("n_bytes") == F.col("size"))
    dealt = src.join(F.broadcast(repeated) if few else repeated.hint("merge"), same, "left")
    dealt = dealt.withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string")))
    info = b"software: reelspark\r\nformat: WARC File Format 1.1\r\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, records, size = "", None, 0, 0
        store, root = _opened(folder)

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

        for b in batches:
            for i in range(b.num_rows):
                if out is None:
                    leaf = f"{uuid.uuid4().hex}.warc.gz"
                    store.create_dir(root, recursive=True)
                    name, out = f"{folder}/{leaf}", store.open_output_stream(f"{root}/{leaf}", compression=None)
                    first = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), ("WARC-Filename", leaf), ("Content-Type", "application/warc-fields")], [info], level)
                    out.write(first)
                    records, size = 1, len(first)
                member = _record({c: b.column(c)[i].as_py() for c in ("page", "url", "payload", "digest", "n_bytes", "refers_to")}, date, level)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    small_batches(spark)
    return work.table(dealt.select("page", "url", "payload", "digest", "n_bytes", "refers_to").mapInArrow(run, MANIFEST))


# --- reading -----------------------------------------------------------------


class BadRecord(ValueError):
    """A record that breaks the format; the reader goes on behind it."""


class _Raw:
    """Bytes of a file in order, with what was read too far put back."""

    def __init__(self, read: Callable[[int], bytes]):
        self._read, self._held, self._last, self.at = read, b"", b"", 0

    def take(self) -> bytes:
        self._last, self._held = self._held or self._read(STEP), b""
        self.at += len(self._last)
        return self._last

    def back(self, data: bytes) -> None:
        self._held = data + self._held
        self.at -= len(data)

    def again(self, start: int) -> None:
        """After a failure in the record at ``start``: puts back what was taken last,
        since good records may follow in it, but not the record's own first byte."""
        if not self._held:
            self.back(self._last[int(self.at - len(self._last) <= start) :])

    def to_magic(self) -> bool:
        """Skips to the next place that may begin a gzip member."""
        last = b""
        while data := self.take():
            data = last + data
            at = data.find(b"\x1f\x8b\x08")
            if at >= 0:
                self.back(data[at:])
                return True
            last = data[-2:]
        return False


def _inflate(raw: _Raw) -> Iterator[bytes]:
    """The member that begins here, in pieces of at most ``STEP`` bytes."""
    z = zlib.decompressobj(31)
    data = b""
    while not z.eof:
        data = z.unconsumed_tail or raw.take()
        if not data:
            raise BadRecord("the member is cut off")
        try:
            piece = z.decompress(data, STEP)
        except zlib.error as e:
            raise BadRecord(f"the member does not inflate: {e}") from None
        if piece:
            yield piece
    raw.back(z.unused_data)


def _digest(declared: str) -> Callable | None:
    """Hash object for a declared ``algorithm:value``, None if it is unknown."""
    name = declared.partition(":")[0].lower().replace("-", "")
    return hashlib.new(name) if name in ("md5", "sha1", "sha256", "sha512") else None


def _agrees(declared: str, h) -> bool:
    """Hex or base-32 value of the digest."""
    value = declared.partition(":")[2].strip()
    return value.lower() == h.hexdigest() or value.upper().rstrip("=") == base64.b32encode(h.digest()).decode().rstrip("=")


class _Block:
    """What is learnt from a block while it streams by: digests, where the HTTP
    header ends, and the payload itself where it is wanted."""

    def __init__(self, head: dict[str, str], keep: bool):
        self.http = head.get("content-type", "").replace(" ", "").lower().startswith("application/http")
        self.front, self.keep = (b"" if self.http else None), [] if keep else None
        self.declared = {k: d for k in ("warc-block-digest", "warc-payload-digest") if (d := head.get(k)) and (k != "warc-payload-digest" or head.get("warc-type") != "revisit")}
        self.check = {k: h for k, d in self.declared.items() if (h := _digest(d))}
        self.sha, self.n_payload = hashlib.sha256(), 0

    def add(self, data: bytes) -> None:
        if "warc-block-digest" in self.check:
            self.check["warc-block-digest"].update(data)
        if self.front is not None:
            self.front += data
            at = self.front.find(b"\r\n\r\n")
            if at < 0:
                if len(self.front) > HEADER_BYTES:
                    raise BadRecord("the HTTP header has no end")
                return
            data, self.front = self.front[at + 4 :], None
        self.n_payload += len(data)
        self.sha.update(data)
        if "warc-payload-digest" in self.check:
            self.check["warc-payload-digest"].update(data)
        if self.keep is not None:
            self.keep.append(data)

    def wrong(self) -> str | None:
        return next((f"{k} does not agree" for k, h in self.check.items() if not _agrees(self.declared[k], h)), None)


def _headers(text: str) -> dict[str, str]:
    lines = text.split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise BadRecord("no WARC version line")
    out, name = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise BadRecord("a header line has no colon")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def _one(raw: _Raw, keep: bool) -> dict:
    pieces = _inflate(raw)
    head = b""
    while b"\r\n\r\n" not in head:
        if len(head) > HEADER_BYTES:
            raise BadRecord("the header has no end")
        piece = next(pieces, None)
        if piece is None:
            raise BadRecord("the member ends in its header")
        head += piece
    head, _, rest = head.partition(b"\r\n\r\n")
    fields = _headers(head.decode("utf-8", "replace"))
    length = fields.get("content-length", "")
    if not length.isdecimal():
        raise BadRecord("no content length")
    left, block = int(length), _Block(fields, keep)
    after = b""
    while True:
        block.add(rest[:left])
        after += rest[left : left + 5 - len(after)]
        left = max(left - len(rest), 0)
        rest = next(pieces, None)
        if rest is None:
            break
    if left:
        raise BadRecord("the block is shorter than its content length")
    if after != b"\r\n\r\n":
        raise BadRecord("the block is not followed by two line ends and the member's end")
    bare = lambda k: v.strip("<>") if (v := fields.get(k)) else None
    out = {
        "record_id": bare("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "refers_to": bare("warc-refers-to"), "block_bytes": int(length),
        "payload_bytes": block.n_payload, "payload_digest": block.sha.hexdigest(), "declared_digest": fields.get("warc-payload-digest"), "payload": b"".join(block.keep) if keep else None,
    }
    if bad := block.wrong():
        return out | {"verified": False, "error": bad}
    return out | {"verified": True if block.check else None}


def read_records(read: Callable[[int], bytes], keep_payload: bool = False) -> Iterator[dict]:
    """Records of one archive in order, from ``read(n)`` that gives its next bytes.

    Memory is bounded by ``STEP`` and ``HEADER_BYTES`` (and the payload if it is
    kept).  A record that breaks the format, or whose digests do not agree, has
    ``error``; after the former the reader goes on at the next place where a member
    with a WARC header begins, and tells of no further failure before it.
    """
    raw, lost = _Raw(read), False
    while True:
        data = raw.take()
        if not data:
            return
        at = raw.at - len(data)
        raw.back(data)
        try:
            row = _one(raw, keep_payload)
            lost = False
            yield {"offset": at} | row
        except BadRecord as e:
            if not lost:
                yield {"offset": at, "error": str(e)}
            lost = True
            raw.again(at)
            if not raw.to_magic():
                return


def read_archives(files: DataFrame, keep_payload: bool = False) -> DataFrame:
    """``RECORDS`` of the archives named in ``files(file)``, URIs that all machines
    reach; with a column ``content`` (as of Spark's ``binaryFile``) that is read
    instead, for stores that only Spark reaches.

    An archive is read in order by one task in constant memory; archives are dealt
    over the tasks.  An archive that cannot be opened gives a row with ``error``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(RECORDS))
    inside = "content" in files.columns
    blank = dict.fromkeys(kind.names)

    def rows_of(name, content):
        import io

        try:
            if inside:
                stream = io.BytesIO(content or b"")
            else:
                store, path = _opened(name)
                stream = store.open_input_stream(path, compression=None)
        except (OSError, pa.ArrowException) as e:
            yield {"error": f"cannot be opened: {type(e).__name__}"}
            return
        with stream:
            yield from read_records(stream.read, keep_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, rows, size = b.column("file")[i].as_py(), [], 0
                for r in rows_of(name, b.column("content")[i].as_py() if inside else None):
                    rows.append(blank | {"file": name} | r)
                    size += 400 + len(r.get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    if inside:
        return files.select("file", "content").mapInArrow(run, RECORDS)
    return files.select("file").repartition(max(files.sparkSession.sparkContext.defaultParallelism * 4, 8)).mapInArrow(run, RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Responses and revisits, the latter with ``payload_bytes`` and ``payload_digest``
    of the response that they refer to and whose digest they state; null where there
    is none.  One row of each response takes part, so hot ones only lengthen one
    side of the join, which Spark splits."""
    named = F.element_at(F.split("declared_digest", ":"), -1)
    answers = records.where("record_type = 'response' and error is null").groupBy(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("named")).agg(F.max("payload_bytes").alias("full_bytes"))
    again = records.where("record_type = 'revisit'").withColumn("named", named).join(answers, ["refers_to", "named"], "left")
    again = again.withColumns({"payload_bytes": F.col("full_bytes"), "payload_digest": F.when(F.col("full_bytes").isNotNull(), F.col("named"))})
    return records.where("record_type = 'response'").unionByName(again.select(*records.columns))


def archive_pages(spark: SparkSession, pages: DataFrame, least: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` as archives, reads these back and returns the resolved
    records with ``page`` and ``refers_to`` as ids in text; raises if a record
    cannot be read or verified.  No pages give no rows."""
    work = Workspace(spark, "warc")
    manifest = write_archives(spark, pages, f"{work.root}/archives", work, least=least, archive_bytes=archive_bytes)
    records = work.table(read_archives(manifest).drop("payload"))
    seen, bad = records.agg(F.count("*"), F.count("error")).first()
    wanted = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if bad or seen != wanted:
        raise ValueError(f"{seen} records read of {wanted} written, {bad} of them with errors")
    id_of = lambda c: F.when(F.startswith(c, F.lit(RECORD_ID)), F.url_decode(F.substring(c, len(RECORD_ID) + 1, 1 << 30)))
    return resolve_revisits(records).withColumns({"page": id_of(F.col("record_id")), "refers_to": id_of(F.col("refers_to"))})
