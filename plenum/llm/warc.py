"""WARC archives with a two-level capture index (operator 6).

Pages are sorted by their reversed-host URL key and page id over the archives. Each archive holds gzip members,
one for a record; beside it stand an index of (key, page, offset, length) lines in compressed blocks of BLOCK
entries, and a sparse directory with each block's first entry and place. Captures are asked for by key and page:
a binary search over the archives' first entries (MAX_ARCHIVES at most) names the archive, one in its directory
the block, one in the block the entries, and the records are read by range, neighbours together.

Of records with equal payloads of at least MIN_REVISIT bytes, that of the largest page id is the response,
others are revisits of it without payload.

Defined cases: null html is an empty payload; null urls have an empty key; null page ids are
written without a number, read back as null, and never are what others revisit; repeated page ids are written
each for itself, and rows that share payload and the largest page id all are responses; an empty table gives
no records; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from plenum.llm.common import new_folder

MIN_REVISIT, BLOCK = 1000, 256
#: Archives hold about so many pages, more where there would be more than MAX_ARCHIVES of them.
PAGES_PER_ARCHIVE, MAX_ARCHIVES = 4_000, 20_000
#: Bytes that a range read takes at most, unless a single record is longer.
READ_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"  # a fixed date, as the pages have none


def url_key(url: Column) -> Column:
    """org,example,www)/path?query: sorts captures of one domain together. What is no URL is its own key."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    host, path, query = F.regexp_replace(F.lower(part("HOST")), r"\.+$", ""), part("PATH"), part("QUERY")
    turned = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    whole = F.concat(turned, F.lit(")"), F.when(path != "", path).otherwise("/"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", whole).otherwise(F.coalesce(url, F.lit("")))


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit keeps the HTTP header only, with the full payload's Content-Length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    more = "" if refers_to is None else f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:{refers_to}>\r\n"
    target = re.sub(r"[\r\n]", "", url or "")
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{'' if page is None else page}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {target}\r\nWARC-Payload-Digest: sha1:{digest}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """Headers and payload of a member; the digest of a response is taken from its payload anew."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    digest = named if revisit else hashlib.sha1(payload).hexdigest()
    if digest != named or not revisit and size != len(payload):
        raise ValueError("a record's payload doesn't match its digest or length")
    page = lambda x: int(n) if (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": page(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page(fields["WARC-Refers-To"]) if revisit else None, "url": fields["WARC-Target-URI"], "payload": payload}


def _open(uri: str):
    """File system and path of a URI; a bare path is local."""
    return fs.FileSystem.from_uri(uri if re.match(r"\w+:/", uri) else os.path.abspath(uri))


def _write(batches, folder):
    """One archive of a task's sorted pages. A retry writes under its own name and renames at the end, so readers see whole archives only."""
    store, path = _open(folder)
    task = TaskContext.get()
    name, attempt = f"part-{task.partitionId():05d}", f".{task.taskAttemptId()}"
    lines, places, offset, at, marks = [], [], 0, None, {}
    out = store.open_output_stream(f"{path}/{name}.warc.gz{attempt}")
    for b in batches:
        for page, url, key, payload, digest, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "key", "payload", "digest", "refers_to")), strict=True):
            if at != (key, page):
                at, marks = (key, page), {}
            if payload is None:  # a mark: this page's record of that digest is a revisit
                marks[digest] = refers
                continue
            member = record(page, url, payload, digest, marks.get(digest))
            out.write(member)
            lines.append(json.dumps([key, page, offset, len(member)]))
            offset += len(member)
    out.close()
    at = 0
    with store.open_output_stream(f"{path}/{name}.cdx.gz{attempt}") as index:
        for i in range(0, len(lines), BLOCK):
            block = zlib.compress("\n".join(lines[i : i + BLOCK]).encode())
            index.write(block)
            places.append([*json.loads(lines[i])[:2], at, len(block)])
            at += len(block)
    with store.open_output_stream(f"{path}/{name}.dir{attempt}") as sparse:
        sparse.write("\n".join(map(json.dumps, places)).encode())
    for end in ("warc.gz", "cdx.gz", "dir"):
        store.move(f"{path}/{name}.{end}{attempt}", f"{path}/{name}.{end}")
    if places:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([places[0][0]], pa.string()), pa.array([places[0][1]], pa.int64()), pa.array([len(lines)], pa.int64())], ["archive", "first_key", "first_page", "records"])


def _entry(key: str, page: int | None) -> tuple:
    """The order of captures; a missing page id comes first."""
    return key, page is not None, page or 0


class Archives:
    """Binary searches and range reads over archives. tops: (first key, first page, name) of each."""

    def __init__(self, folder: str, tops: list[tuple]):
        self.store, self.path = _open(folder)
        found = sorted((_entry(k, p), name) for k, p, name in tops)
        self.firsts, self.names = [e for e, _ in found], [n for _, n in found]
        self.name, self.directory, self.at, self.block = None, [], None, []

    def _bytes(self, end: str, offset: int | None = None, length: int | None = None) -> bytes:
        with self.store.open_input_file(f"{self.path}/{self.name}.{end}") as f:
            return f.read() if offset is None else f.read_at(length, offset)

    def _enter(self, name: str) -> None:
        if name != self.name:
            self.name, self.at = name, None
            self.directory = [(_entry(k, p), o, n) for k, p, o, n in map(json.loads, self._bytes("dir").decode().split("\n"))]

    def _entries(self, i: int) -> list[tuple]:
        if i != self.at:
            _, offset, length = self.directory[i]
            self.at = i
            self.block = [(_entry(k, p), o, n) for k, p, o, n in map(json.loads, zlib.decompress(self._bytes("cdx.gz", offset, length)).decode().split("\n"))]
        return self.block

    def places(self, first: tuple, last: tuple):
        """(archive, offset, length) of the records between two entries, both included."""
        i = max(0, bisect.bisect_left(self.firsts, first) - 1)
        while i < len(self.names) and self.firsts[i] <= last:
            self._enter(self.names[i])
            blocks = [e for e, _, _ in self.directory]
            j = max(0, bisect.bisect_left(blocks, first) - 1)
            while j < len(blocks) and blocks[j] <= last:
                found = self._entries(j)
                for _, offset, length in found[bisect.bisect_left(found, first, key=lambda e: e[0]) : bisect.bisect_right(found, last, key=lambda e: e[0])]:
                    yield self.name, offset, length
                j += 1
            i += 1

    def records(self, places):
        """Lists of parsed records; those that stand together are read together."""
        run: list[tuple] = []
        for place in places:
            name, offset, length = place
            if run and (run[-1][0] != name or run[-1][1] + run[-1][2] != offset or offset + length - run[0][1] > READ_BYTES):
                yield self._read(run)
                run = []
            run.append(place)
        if run:
            yield self._read(run)

    def _read(self, run: list[tuple]) -> list[dict]:
        begin = run[0][1]
        with self.store.open_input_file(f"{self.path}/{run[0][0]}.warc.gz") as f:
            whole = f.read_at(run[-1][1] + run[-1][2] - begin, begin)
        return [parse(whole[o - begin : o - begin + n]) for _, o, n in run]


def _found(batches, folder, tops):
    own = Archives(folder, tops)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    asked = (_entry(k, p) for b in batches for k, p in zip(b.column("key").to_pylist(), b.column("page_id").to_pylist(), strict=True))
    for rows in own.records(x for e in asked for x in own.places(e, e)):
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string() if c in ("payload_digest", "record_type") else pa.int64()) for c in names], list(names))


def with_marks(pages: DataFrame) -> DataFrame:
    """page_id, url, key, payload, digest, refers_to: the pages, and marks without payload that name revisits and their response.

    Only keys, ids and digests of payloads that may repeat are grouped and joined; payloads aren't.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", url_key(F.col("url")).alias("key"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = rows.filter(F.octet_length("payload") >= MIN_REVISIT).select("page_id", "key", "digest")
    group = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1")
    marks = large.join(group, "digest").filter("not page_id <=> response and response is not null")
    nothing = F.lit(None)
    marks = marks.select("page_id", nothing.cast("string").alias("url"), "key", nothing.cast("binary").alias("payload"), "digest", F.col("response").alias("refers_to"))
    return rows.withColumn("refers_to", nothing.cast("long")).unionByName(marks)


def write_archives(pages: DataFrame, folder: str, n_archives: int | None = None) -> DataFrame:
    """Write the archives with their indexes and directories under folder; a row for each: archive, first_key, first_page, records.

    Marks are dealt and sorted with the pages, just before theirs, so that payloads are shuffled once.
    """
    spark = pages.sparkSession
    n = n_archives or max(1, min(MAX_ARCHIVES, -(-pages.count() // PAGES_PER_ARCHIVE)))
    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    rows = with_marks(pages.select("page_id", "url", "html")).repartitionByRange(n, "key", "page_id")
    rows = rows.sortWithinPartitions("key", "page_id", F.col("payload").isNotNull())
    rows.mapInArrow(lambda bs: _write(bs, folder), "archive string, first_key string, first_page long, records long").write.parquet(f"{folder}/archives")
    return spark.read.parquet(f"{folder}/archives")


def tops(archives: DataFrame) -> list[tuple]:
    """First key, first page and name of each archive: MAX_ARCHIVES rows at most."""
    return [(r.first_key, r.first_page, r.archive) for r in archives.collect()]


def read_captures(asked: DataFrame, archives: DataFrame, folder: str) -> DataFrame:
    """The records of the captures asked for (key, page_id), each as often as it was written. Equal and neighbouring captures are dealt to one task, in order."""
    first = tops(archives)
    n = max(1, min(len(first), asked.sparkSession.sparkContext.defaultParallelism * 4))
    rows = asked.select("key", "page_id").distinct().repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    return rows.mapInArrow(lambda bs: _found(bs, folder, first), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def lookup(archives: DataFrame, folder: str, url: str) -> list[dict]:
    """All captures of a URL."""
    key = archives.sparkSession.range(1).select(url_key(F.lit(url)).alias("key")).first().key
    own = Archives(folder, tops(archives))
    return [r for rows in own.records(own.places((key, False, 0), (key, True, 1 << 63))) for r in rows]


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read every page's record back through the index."""
    folder = new_folder(pages.sparkSession, "warc")
    asked = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"))
    return read_captures(asked, write_archives(pages, folder), folder)
