"""WARC records in ZIP archives, read by range.

Each archive holds stored members archive/NNNNNN.warc.gz, in which each record is a gzip member of its own, and
indexes/index.cdxj, a line of JSON for each record: its page, member, offset and length. A reader parses the (ZIP64)
central directory, reads the index, and reads each record by its range; nothing is extracted.

Of records with one payload of at least `least` bytes that with the smallest page_id is the response, the others are
revisits without the payload; smaller payloads are always responses.

Null html: empty. Null page_id: a response (it can't be named), unless its payload has a named one, which it then revisits.
Rows with one page_id and payload: all responses, as none is smaller. Null url: the header is left out. Empty table: no
archive, no row. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, open_fs, scratch
from .zip_archive import StoredZipReader, StoredZipWriter

#: Bytes of a member and of an archive, about.
MEMBER, ARCHIVE = 16 << 20, 256 << 20
INDEX = "indexes/index.cdxj"
_DATE = "2000-01-01T00:00:00Z"


class RecordError(ValueError):
    """A record isn't what its headers say."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, again: int | None = None) -> str:
    """Of the first record of a page with this payload, or of one that comes again (by its row)."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}' + ('' if again is None else f' {again}'))}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, again: int | None = None) -> bytes:
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest, again),
        "WARC-Refers-To": None if refers_to is None else record_id(refers_to, digest),
        "WARC-Date": _DATE,
        "WARC-Target-URI": None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "WARC-Profile": None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "X-Page-ID": None if page_id is None else str(page_id),
        "X-Refers-To-Page-ID": None if refers_to is None else str(refers_to),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """page_id, url, payload (None for a revisit), payload_bytes, payload_digest, record_type, refers_to, all checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise RecordError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise RecordError("the block isn't the one that was written")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or base32_sha1(payload) != digest):
        raise RecordError("the payload isn't the one that was written")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload if response else None, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "record_id": fields["WARC-Record-ID"], "refers_to_record": fields.get("WARC-Refers-To")}


class _Archive:
    """One archive as it is written, under a name of the attempt's own until it is whole."""

    def __init__(self, out_dir: str, name: str):
        self.fs, folder = open_fs(out_dir)
        self.fs.create_dir(folder, recursive=True)
        self.name, self.path = name, f"{folder}/{name}"
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.zip, self.index, self.member, self.size, self.n = StoredZipWriter(self.out), [], bytearray(), 0, 0

    def add(self, page_id: int | None, record: bytes) -> None:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = pack.compress(record) + pack.flush()
        self.index.append({"page": page_id, "filename": f"archive/{self.n:06d}.warc.gz", "offset": len(self.member), "length": len(data)})
        self.member += data
        self.size += len(data)
        if len(self.member) >= MEMBER:
            self._end_member()

    def _end_member(self) -> None:
        self.zip.add(f"archive/{self.n:06d}.warc.gz", bytes(self.member))
        self.member, self.n = bytearray(), self.n + 1

    def close(self) -> pd.DataFrame:
        if self.member:
            self._end_member()
        self.zip.add(INDEX, "".join(json.dumps(x) + "\n" for x in self.index).encode())
        self.zip.close()
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return pd.DataFrame({"file": [self.name], "n_records": [len(self.index)]})


def repeats(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (row, page_id, digest, size) -> row, refers_to: rows whose payload another row has, but for the first of each payload.

    The first is that of the smallest page_id; refers_to is this page_id, or null if it is the row's own or there is none.
    """
    own = pages.filter(F.col("size") >= least)
    order = F.struct(F.col("page_id").isNull(), "page_id", "row")
    shared = materialize(own.groupBy("digest").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", F.col("o.page_id").alias("least"), F.col("o.row").alias("first")), "shared-payloads")
    later = own.join(shared, "digest").filter("row <> first")
    return materialize(later.select("row", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")).alias("refers_to")), "repeats")


def write_warc(pages: DataFrame, out_dir: str, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) -> file, n_records of the archives written: one row each, in a table of its own.

    The pages are numbered and written once; the rows that repeat a payload are joined back by number, so html is shuffled
    only where these are too many to broadcast.
    """
    html = F.coalesce("html", F.lit(""))
    numbered = materialize(pages.select("page_id", "url", "html", F.sha1(html).alias("digest"), F.octet_length(html).alias("size")).withColumn("row", F.monotonically_increasing_id()), "pages")
    later = repeats(numbered.select("row", "page_id", "digest", "size"), least).withColumn("again", F.col("row"))
    rows = numbered.select("row", "page_id", "url", "html").join(later, "row", "left").select("page_id", "url", "html", "refers_to", "again")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, archive, n = TaskContext.get().partitionId(), None, 0
        for x in batches:
            for p, u, h, r, a in zip(x["page_id"].astype("Int64"), x["url"], x["html"], x["refers_to"].astype("Int64"), x["again"].astype("Int64"), strict=True):
                p, r, a = (None if v is pd.NA else int(v) for v in (p, r, a))
                archive = archive or _Archive(out_dir, f"pages-{task:06d}-{n:04d}.zip")
                archive.add(p, record_bytes(p, u, (h or "").encode(), r, a))
                if archive.size >= ARCHIVE:
                    yield archive.close()
                    archive, n = None, n + 1
        if archive:
            yield archive.close()

    return materialize(rows.mapInPandas(write, "file string, n_records long"), "archives")


def read_archive(fs, path: str) -> Iterator[dict]:
    """The records of one archive, each read by its range."""
    with fs.open_input_file(path) as f:

        def read_at(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        archive = StoredZipReader(read_at, f.size())
        begin = {name: archive.data_at(name) for name in archive.members}
        for line in archive.read(INDEX).splitlines():
            x = json.loads(line)
            if x["offset"] + x["length"] > archive.members[x["filename"]][1]:
                raise RecordError("the index points beyond a member")
            found = parse_record(zlib.decompress(read_at(begin[x["filename"]] + x["offset"], x["length"]), 31))
            if found["page_id"] != x["page"]:
                raise RecordError("the index names another page")
            yield found


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string"


def read_warc(spark: SparkSession, out_dir: str, files: DataFrame, payloads: bool = True) -> DataFrame:
    """files (file) -> a row for each record."""
    columns = [c.split()[0] for c in READ.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[dict]) -> pd.DataFrame:
            y = pd.DataFrame(rows, columns=columns)
            return y.astype({"page_id": "Int64", "refers_to": "Int64"})

        for x in batches:
            for file in x["file"]:
                fs, folder = open_fs(out_dir)
                rows, size = [], 0
                for r in read_archive(fs, f"{folder}/{file}"):
                    rows.append(r if payloads else r | {"payload": None})
                    size += r["payload_bytes"] if payloads else 200
                    if size > 8 << 20:
                        yield frame(rows)
                        rows, size = [], 0
                if rows:
                    yield frame(rows)

    return files.select("file").repartition(max(1, files.count())).mapInPandas(read, READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    out_dir = scratch(spark, "op3")
    files = write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), out_dir)
    return read_warc(spark, out_dir, files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no base-32 function: five bits at a time by their letters.
SQL = r"""
WITH d AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS least, count(*) AS n FROM d GROUP BY h),
b AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> (15 - 5 * j)) % 32, 1), '' ORDER BY i, j) AS digest
  FROM (SELECT h, i, CAST('0x' || substr(h, 1 + 5 * i, 5) AS BIGINT) AS v FROM (SELECT DISTINCT h FROM d), range(8) r(i)), range(4) q(j) GROUP BY h)
SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest,
  CASE WHEN least IS NOT NULL AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN least IS NOT NULL AND page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM d JOIN g USING (h) JOIN b USING (h)
"""
