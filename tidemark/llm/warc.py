"""WARC archives: written with segmented records, read back by segment reassembly.

Writing (``write_archives``): every row becomes a record of HTTP headers and a body in chunked transfer
framing. A block longer than ``segment_bytes`` is cut into a first record and *continuation* records that
name it by WARC-Segment-Origin-ID and are numbered; the last one tells the total length. Of rows with equal payloads, the first by id (of equal ids the
one with the least hash) is a response and the others are revisits that refer to it and hold no body.
Records are rows of Spark's text writer whose line separator is the end of a WARC record, so files are committed like
any other output and a lost executor leaves none behind.

Reading (``read_archives``): archives are read by Spark's text reader with the version mark as the separator, and what a
payload with that mark has cut is joined again by Content-Length. A gzip file, one member or many, is
streamed by one task, as is usual for WARC; uncompressed ones have to be smaller than
spark.sql.files.maxPartitionBytes to be kept in one split. Unsegmented records are decoded where they are read. Segments
are grouped by their origin, ordered by number and verified: numbers 1 to n without gaps, one
first and one last, and the total length. Then the chunked framing is decoded (or Content-Length is obeyed) and
the payload is compared with its digest.

``status`` of a record is "ok", or what is wrong: "cut short" (its file ends within it), "segments missing", "segments conflict" (two
of one number that differ; equal ones count once), "total length", "framing" (HTTP headers or chunks), "digest", or
"unresolved" (a revisit of what isn't there). Faulty records keep their row, with a null payload and size.

Defined results: a null payload is empty; an empty one has length 0 and a digest like any other; rows with equal ids are records of
their own, equal rows too, of which one is the response at most; null ids come after all others; very long payloads are
cut into segments and have to fit in a row once they are put together again; an empty table writes
archives without records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, MARK, END = b"WARC/1.1\r\n", b"WARC/", b"\r\n\r\n"
#: Bytes of a block in a record, above which it is segmented, and of a chunk of the transfer framing.
SEGMENT_BYTES, CHUNK_BYTES = 1 << 20, 1 << 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"  # of a capture whose time isn't known
RECORDS = "name string, id string, kind string, uri string, refers_to string, payload binary, payload_bytes long, digest string, status string"
PARTS = f"{RECORDS}, origin string, number int, total long, block binary"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(mark: str, copy: int, key: str | None) -> str:
    """A name that no two rows share and that tells the row's id."""
    return f"<urn:row:{mark}.{copy}:{'' if key is None else 'k' + quote(key, safe='')}>"


def id_of(name: str | None) -> str | None:
    """The id in a name that record_id made; any other name is its own id."""
    parts = (name or "").strip("<>").split(":", 3)
    if len(parts) < 4 or parts[:2] != ["urn", "row"]:
        return name
    return unquote(parts[3][1:]) if parts[3] else None


def chunked(payload: bytes) -> bytes:
    """A payload in chunked transfer framing."""
    out = []
    for i in range(0, len(payload), CHUNK_BYTES):
        piece = payload[i : i + CHUNK_BYTES]
        out += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; extensions and trailers are skipped. None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            break
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2
    while body[at : at + 2] != b"\r\n":  # trailers
        at = body.find(b"\r\n", at) + 2
        if at < 2:
            return None
    return b"".join(out)


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP response, or None."""
    end = block.find(END)
    if not block.startswith(b"HTTP/") or end < 0:
        return None
    headers, body = _fields(block[:end]), block[end + 4 :]
    if headers.get("transfer-encoding", "").lower() == "chunked":
        return unchunked(body)
    length = headers.get("content-length")
    if length is None:
        return body
    return body[: int(length)] if length.isdigit() and int(length) <= len(body) else None


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the two line ends behind it, which the writer puts there."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return VERSION + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def write_archives(rows: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, least_bytes: int = 0) -> None:
    """Writes rows (id, uri, payload binary) as archives in a new folder; payloads under least_bytes are always responses.

    Rows are known by a hash of all three, so nothing depends on their order; equal rows are counted before they are
    moved. Only hashes meet by payload, so one that a third of the rows share moves no texts to one place.
    """
    text = lambda c: F.coalesce(F.concat(F.lit("k"), F.col(c).cast("string")), F.lit(""))
    rows = rows.select("id", F.col("uri").cast("string").alias("uri"), F.coalesce(F.col("payload"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    rows = rows.withColumn("mark", F.md5(F.concat(text("id"), F.lit("\0"), text("uri"), F.lit("\0"), F.col("digest"))))
    keys = rows.where(F.length("payload") >= least_bytes).select("mark", "id", "digest").distinct()
    firsts = keys.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "mark")).alias("f"))
    decided = keys.select("mark", "digest").join(firsts, "digest").select("mark", F.col("f.mark").alias("first"), F.col("f.id").cast("string").alias("first_id"))
    each = rows.groupBy("mark").agg(F.any_value("id").cast("string").alias("id"), F.any_value("uri").alias("uri"), F.any_value("payload").alias("payload"), F.count("*").alias("copies"))
    whole = each.join(decided.hint("shuffle_hash"), "mark", "left")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _columns([(_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:file:{TaskContext.get().partitionId()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"software: tidemark\r\n"),)], ["record"], [pa.binary()])
        for b in batches:
            out, size = [], 0
            mark, key, uri, first, first_id, copies = (b.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6))
            for mark, key, uri, payload, first, first_id, copy in ((*x[:-1], i) for x in zip(mark, key, uri, b.column(3), first, first_id, copies, strict=True) for i in range(x[-1])):
                payload = payload.as_py()
                name = record_id(mark, copy, key)
                of_payload = "sha1:" + base32(hashlib.sha1(payload).digest())
                # a line end would begin another header
                fields = {"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Date": DATE, "WARC-Target-URI": None if uri is None else quote(uri, safe="%:/?#[]@!$&'()*+,;=~"), "WARC-Payload-Digest": of_payload, "Content-Type": "application/http;msgtype=response"}
                if first is not None and (first, 0) != (mark, copy):
                    fields |= {"WARC-Type": "revisit", "WARC-Refers-To": record_id(first, 0, first_id), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    out.append((_record(fields, HTTP),))
                    continue
                block = HTTP + chunked(payload)
                pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                for i, piece in enumerate(pieces, 1):
                    own = fields if i == 1 else {"WARC-Type": "continuation", "WARC-Record-ID": record_id(mark, copy, f"{key}#{i}"), "WARC-Date": DATE, "WARC-Segment-Origin-ID": name}
                    own = own | {"WARC-Block-Digest": "sha1:" + base32(hashlib.sha1(piece).digest())}
                    if len(pieces) > 1:
                        own |= {"WARC-Segment-Number": i, "WARC-Segment-Total-Length": len(block) if i == len(pieces) else None}
                    out.append((_record(own, piece),))
                    size += len(piece)
                if size >= 8 << 20:
                    yield _columns(out, ["record"], [pa.binary()])
                    out, size = [], 0
            yield _columns(out, ["record"], [pa.binary()])

    made = whole.select("mark", "id", "uri", "payload", "first", "first_id", "copies").mapInArrow(records, "record binary")
    lines = made.select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def _columns(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


class _Cut:
    """Joins what lies between marks to whole records: header, length and block."""

    def __init__(self) -> None:
        self.held: list[bytes] = []
        self.size = 0
        self.need: int | None = None

    def add(self, piece: bytes) -> tuple[dict[str, str], bytes] | None:
        self.held.append(MARK + piece)
        self.size += len(MARK) + len(piece)
        if self.need is None:
            whole = b"".join(self.held)
            end = whole.find(END)
            if end < 0:
                self.held = [whole]
                return None
            length = _fields(whole[:end]).get("content-length", "")
            self.need = end + 4 + (int(length) if length.isdigit() else 0)
        if self.size < self.need:
            return None
        whole, need = b"".join(self.held), self.need
        self.__init__()
        end = whole.find(END)
        return _fields(whole[:end]), whole[end + 4 : need]


def _decoded(fields: dict[str, str], block: bytes | None, status: str = "ok", keep: bool = True) -> tuple:
    """A record's row by RECORDS."""
    name = fields.get("warc-record-id")
    kind, refers = fields.get("warc-type"), fields.get("warc-refers-to")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    payload = None
    if status == "ok" and kind == "response":
        payload = http_payload(block)
        if payload is None:
            status = "framing"
        else:
            own = base32(hashlib.sha1(payload).digest())
            if digest not in (None, own):
                payload, status = None, "digest"
            digest = digest or own
    size = None if payload is None else len(payload)
    return name, id_of(name), kind, fields.get("warc-target-uri"), refers, payload if keep else None, size, digest, status


NAMES = [x.split()[0] for x in PARTS.split(", ")]
KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
TYPES = [KINDS[x.split()[1]] for x in PARTS.split(", ")]
N = len(RECORDS.split(", "))


def _parts(lines: DataFrame, segments: bool, keep: bool) -> DataFrame:
    """Records by PARTS: either whole ones, decoded, or segments with their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, cut = None, _Cut()

        def short() -> list[tuple]:
            head = b"".join(cut.held)
            return [(*_decoded(_fields(head), None, "cut short"), *[None] * 4)] if not segments and b":" in head else []

        for b in batches:
            out, size = [], 0
            for path, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                piece = piece.as_py()
                if path != file:
                    out += short()
                    file, cut = path, _Cut()
                if not cut.held and not piece.strip():  # before the first record of a file
                    continue
                found = cut.add(piece)
                if found is None:
                    continue
                fields, block = found
                number = fields.get("warc-segment-number", "")
                if number.isdigit() and segments:
                    name = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
                    total = fields.get("warc-segment-total-length", "")
                    out.append((*_decoded(fields, None, "segment"), name, int(number), int(total) if total.isdigit() else None, block))
                elif not number.isdigit() and not segments and fields.get("warc-type") != "warcinfo":
                    out.append((*_decoded(fields, block, keep=keep), *[None] * 4))
                else:
                    continue
                size += len(block)
                if size >= 8 << 20:
                    yield _columns(out, NAMES, TYPES)
                    out, size = [], 0
            yield _columns(out, NAMES, TYPES)
        yield _columns(short(), NAMES, TYPES)

    return lines.mapInArrow(run, PARTS)


def _reassembled(segments: DataFrame, keep: bool) -> DataFrame:
    """Records of segments: a task streams through them by origin and number."""

    def joined(rows: list[tuple]) -> tuple:
        first = next((r for r in rows if r[2] == "response"), rows[0])
        numbers = {r[N + 1] for r in rows}
        totals = {r[N + 2] for r in rows if r[N + 2] is not None}
        block, status = b"".join(r[N + 3] for r in rows), "ok"
        if len(numbers) < len(rows):
            status = "segments conflict"
        elif numbers != set(range(1, len(rows) + 1)) or not totals or rows[0][2] == "continuation":
            status = "segments missing"
        elif totals != {len(block)}:
            status = "total length"
        head = {"warc-record-id": rows[0][N], "warc-type": first[2], "warc-target-uri": first[3], "warc-payload-digest": first[7]}
        return _decoded({k: v for k, v in head.items() if v is not None}, block, status, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if held and held[-1][N] != r[N]:
                    yield _columns([joined(held)], NAMES[:N], TYPES[:N])
                    held = []
                if not held or (held[-1][N + 1], held[-1][N + 3]) != (r[N + 1], r[N + 3]):  # equal copies follow each other
                    held.append(r)
        if held:
            yield _columns([joined(held)], NAMES[:N], TYPES[:N])

    dealt = segments.repartition("origin").sortWithinPartitions("origin", "number", F.sha1("block"))
    return dealt.mapInArrow(run, RECORDS)


def read_archives(spark: SparkSession, path: str, keep_payloads: bool = True) -> DataFrame:
    """Records of archives by RECORDS: responses with their payload, revisits and faulty ones without."""
    lines = spark.read.option("lineSep", MARK.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    whole = _parts(lines, False, keep_payloads).select(*NAMES[:N])
    return whole.unionByName(_reassembled(_parts(lines, True, False), keep_payloads))


def resolved(records: DataFrame) -> DataFrame:
    """Records without payloads: a revisit has the size of the response that it refers to, if that is there and has its digest; of_id is that response's id."""
    slim = records.drop("payload")
    of = slim.where("kind = 'response' and status = 'ok'").select(F.col("name").alias("of_name"), F.col("id").alias("of_id"), F.col("payload_bytes").alias("of_bytes"), F.col("digest").alias("of_digest"))
    met = slim.withColumn("of_name", F.when(F.col("kind") == "revisit", F.col("refers_to"))).join(of, "of_name", "left")
    revisit, good = F.col("kind") == "revisit", F.coalesce(F.col("of_digest") == F.col("digest"), F.lit(False))
    return met.select(
        "name", "id", "kind", "uri", "refers_to", F.when(revisit & good, F.col("of_id")).alias("of_id"), F.when(revisit, F.when(good, F.col("of_bytes"))).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "digest",
        F.when(revisit & ~good, F.lit("unresolved")).otherwise(F.col("status")).alias("status"),
    )
