"""WARC archives: records written as gzip members, an index first, byte-range reads from it.

Tasks write archives into the shared folder and hand back one index row for
each record: file, offset, length, URL and digest. The written index is what
counts; a file that a failed attempt left is in no index. Reading takes rows
of the index, sorts them by file and offset, joins near ranges into one read
and cuts the records out of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaworks.llm.shared import filesystem, release, shared_dir, stored

#: Payloads of fewer bytes are always written out.
MIN_BYTES = 1000
#: A file is closed at so many bytes.
FILE_BYTES = 512 << 20
#: Ranges with at most so many bytes between them are one read, of at most so many bytes unless one record is longer.
GAP, READ = 64 << 10, 8 << 20
#: Payloads with copies up to which their digests (about 100 bytes each) are sent to all pages, and parts that one payload's pages are dealt into beyond.
SENT_COPIES, PARTS = 100_000, 16
DATE = "1970-01-01T00:00:00Z"

_INDEX = "page_id long, url string, record_type string, refers_to long, digest string, file string, offset long, length long"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, refers_to: int | None = None) -> bytes:
    """One record. A payload makes it a response; without one it is a revisit of the response of page refers_to. digest: the full payload's SHA-1 in hex."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + (b"\r\n" if payload is None else b"Content-Length: %d\r\n\r\n%b" % (len(payload), payload))
    address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    fields = {
        "WARC-Type": "revisit" if payload is None else "response",
        "WARC-Record-ID": _record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": address,
        "WARC-Page-ID": page_id,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if payload is None else None,
        "WARC-Refers-To": _record_id(refers_to, digest) if payload is None else None,
        "WARC-Refers-To-Page-ID": refers_to if payload is None else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes | None]:
    """The fields of a record, their names in lower case, and its HTTP payload; None for a revisit."""
    head, block = raw.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:20]!r}")
    fields = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
    block = block[: int(fields["content-length"])]
    return fields, None if fields["warc-type"] == "revisit" else block.split(b"\r\n\r\n", 1)[1]


def _writer(folder: str, file_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        out, name, at = None, "", 0
        try:
            for whole in batches:
                for k in range(0, len(whole), 1024):
                    rows = []
                    for row in whole.slice(k, 1024).to_pylist():
                        if out is None or at >= file_bytes:
                            if out is not None:
                                out.close()
                            name, at = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                            out = system.open_output_stream(f"{base}/{name}", compression=None)
                        payload = None if row["refers_to"] is not None else (row["html"] or "").encode()
                        member = gzip.compress(record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"]), 6, mtime=0)
                        out.write(member)
                        rows.append((row["page_id"], row["url"], "response" if row["refers_to"] is None else "revisit", row["refers_to"], row["digest"], f"{folder}/{name}", at, len(member)))
                        at += len(member)
                    yield _batch(rows, _INDEX)
        finally:
            if out is not None:
                out.close()

    return work


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each page below folder; gives the index, a row for each record.

    Of pages with equal payloads of at least min_bytes the one with the
    largest id is written as response, the others as revisits of it; rows that
    repeat the largest id are responses all. A null payload is empty. A page
    without id revisits one that has an id; where no page of a payload has
    one, all are responses. Null URLs stay null. Other columns of pages are
    not read; an empty table gives an empty index.

    The pages themselves are shuffled only if more than SENT_COPIES payloads
    have copies.
    """
    read = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    read = read.withColumns({"digest": F.sha1(F.coalesce("html", F.lit(""))), "size": F.octet_length(F.coalesce("html", F.lit("")))})
    copies = read.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1 AND top IS NOT NULL")
    copies = stored(copies.drop("n"), "warc-copies")
    if copies.count() <= SENT_COPIES:
        joined = read.join(F.broadcast(copies), ["digest", "size"], "left")
    else:
        # A payload that very many pages have is met in parts.
        parted = copies.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        joined = read.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int")).join(parted, ["digest", "size", "part"], "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    system, where = filesystem(folder)
    system.create_dir(where, recursive=True)
    index = stored(joined.select("page_id", "url", "html", "digest", refers_to.alias("refers_to")).mapInArrow(_writer(folder, file_bytes), _INDEX), "warc-index")
    release(copies)
    return index


def _ranges(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Runs of sorted index rows that one read covers."""
    run: list[dict] = []
    for row in rows:
        last = run[-1] if run else None
        if last and (row["file"] != last["file"] or row["offset"] - last["offset"] - last["length"] > GAP or row["offset"] + row["length"] - run[0]["offset"] > READ):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def _reader(payloads: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for run in _ranges(row for batch in batches for row in batch.to_pylist()):
            if run[0]["file"] != name:
                if file is not None:
                    file.close()
                name = run[0]["file"]
                system, path = filesystem(name)
                file = system.open_input_file(path)
            begin = run[0]["offset"]
            data = memoryview(file.read_at(run[-1]["offset"] + run[-1]["length"] - begin, begin))
            rows = []
            for row in run:
                at = row["offset"] - begin
                fields, payload = parsed(zlib.decompress(data[at : at + row["length"]], 31))
                number = lambda key: int(fields[key]) if key in fields else None  # noqa: B023, E731
                digest = hashlib.sha1(payload).hexdigest() if payload is not None else base64.b32decode(fields["warc-payload-digest"][5:]).hex()
                if digest != row["digest"]:
                    raise ValueError(f"{name} at {row['offset']}: the payload is not the index's")
                rows.append((number("warc-page-id"), row["url"], fields["warc-type"], number("warc-refers-to-page-id"), None if payload is None else len(payload), digest, payload.decode() if payloads and payload is not None else None))
            yield _batch(rows, _RECORD)
        if file is not None:
            file.close()

    return work


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that rows of an index name, of any selection of them: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    A revisit has its digest from its own record, but no bytes; with_payloads() gives it those of its response.
    Ids and URLs that were null are null, an empty payload is b''. Rows of the
    index that repeat are read as often; an empty index gives no records.
    """
    ordered = index.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.select("file", "offset", "length", "url", "digest").mapInArrow(_reader(payloads), _RECORD)


def with_payloads(records: DataFrame) -> DataFrame:
    """records in which revisits have size and payload of the response they refer to, which must be among them.

    Where it isn't, both stay null. A response without id is nobody's; several
    of one id and digest have the same payload. No records give none.
    """
    of = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("_of"), F.col("payload_digest").alias("_digest")).agg(F.first("payload_bytes").alias("_bytes"), F.first("payload").alias("_payload"))
    joined = records.join(of, (F.col("refers_to") == F.col("_of")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.select("page_id", "url", "record_type", "refers_to", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", F.coalesce("payload", "_payload").alias("payload"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    A row for each row of pages; odd rows as write_archives() has them.
    """
    index = write_archives(pages, shared_dir(pages.sparkSession, "warc"))
    records = stored(read_archives(index, payloads=False), "warc-read")
    return with_payloads(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
t AS (SELECT digest, n, max(page_id) AS top FROM p WHERE n >= {MIN_BYTES} GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN t USING (digest, n)
"""
