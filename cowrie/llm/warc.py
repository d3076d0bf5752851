"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per capture; captures whose payload
is stored elsewhere become revisit records. ``build_index`` sorts captures by
reversed-host URL key into range parts; a part file holds compressed blocks of
``BLOCK_LINES`` captures and, at its end, a sparse directory with one line per
block. A file with the first key of each part is the upper level. ``lookup``
finds a key's part and block by binary search, reads that block, and reads the
capture by its byte range, in as many tasks as there are parts.

Files are written through ``pyarrow.fs`` under names of their own for each task
attempt; only what a finished task reports is ever referred to, so a lost
executor leaves at most files that nobody reads.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cowrie.llm.common import open_path, shared_dir, small_batches, stash

#: Captures of a compressed index block.
BLOCK_LINES = 300
#: Captures of an index part, about, and the most tasks that read parts.
PART_LINES, READERS = 10_000, 20_000
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 256_000_000
_DATE = "1970-01-01T00:00:00Z"  # the tables hold no capture time


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host, port if any, then path and query; null gives ")"."""
    text = url or ""
    try:
        u = urlsplit(text if "//" in text else f"//{text}")
        host, port = (u.hostname or "").rstrip("."), u.port
    except ValueError:
        return f"){text}"
    place = ",".join(reversed(host.split(".")))
    return f"{place}{f':{port}' if port else ''}){u.path or '/'}{f'?{u.query}' if u.query else ''}"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: response with its payload, or revisit of ``refers_to`` with headers only."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}')}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, dict[str, str]]:
    """WARC headers, payload and HTTP headers of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, payload, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at = None, "", 0
        try:
            for batch in batches:
                lines = []
                for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        files, place = open_path(path)
                        files.create_dir(place.rpartition("/")[0], recursive=True)
                        out, at = files.open_output_stream(place, compression=None), 0
                    member = gzip.compress(record(page, url, (html or "").encode(), refers), 1, mtime=0)
                    out.write(member)
                    lines.append((url_key(url), page, path, at, len(member)))
                    at += len(member)
                cols = list(zip(*lines, strict=True)) or [[]] * 5
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["url_key", "page_id", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every row as a WARC record; return the captures (url_key, page_id, archive, offset, length).

    Payloads are UTF-8 (null: empty). Of equal payloads of at least
    ``least_bytes`` bytes the one with the largest key is the response and the
    others revisit it; shorter ones are all responses. Rows that repeat the
    largest key are responses too. A null key is a capture of its own and only
    revisits a payload that has a key.
    """
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    first = rows.groupBy("digest").agg(F.max("page_id").alias("response"))
    joined = rows.join(first, "digest")
    other = ~F.col("page_id").eqNullSafe(F.col("response")) & (F.octet_length("html") >= least_bytes)
    refers = F.when(other, F.col("response"))
    return stash(joined.select("page_id", "url", "html", refers.alias("refers")).mapInArrow(_writer(folder), "url_key string, page_id long, archive string, offset long, length long"))


def _rank(page: int | None) -> tuple[bool, int]:
    return (page is None, page or 0)


def _index_writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/{uuid.uuid4().hex}.cdx"
        out, block, directory, at, first = None, [], [], 0, None

        def flush() -> None:
            nonlocal at, block
            data = zlib.compress("\n".join(json.dumps(x) for x in block).encode(), 6)
            directory.append([block[0][0], block[0][1], at, len(data)])
            out.write(data)
            at, block = at + len(data), []

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    files, place = open_path(path)
                    files.create_dir(place.rpartition("/")[0], recursive=True)
                    out, first = files.open_output_stream(place, compression=None), line
                block.append(list(line))
                if len(block) == BLOCK_LINES:
                    flush()
        if out is not None:
            if block:
                flush()
            sparse = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(sparse)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((path, pa.string()), (first[0], pa.string()), (first[1], pa.int64()), (at, pa.int64()), (len(sparse), pa.int64()))], names=["part", "url_key", "page_id", "directory_at", "directory_bytes"])

    return run


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the index; return its upper level: part, first key, place of the sparse directory.

    Parts are ranges of (url_key, page_id), so captures of one URL or host may
    fill many parts.
    """
    parts = -(-captures.count() // PART_LINES) or 1
    place = [F.col("url_key").asc(), F.col("page_id").asc_nulls_last()]
    ordered = captures.repartitionByRange(parts, *place).sortWithinPartitions(*place, "archive", "offset")
    return stash(ordered.mapInArrow(_index_writer(folder), "part string, url_key string, page_id long, directory_at long, directory_bytes long"))


def write_heads(index: DataFrame, folder: str) -> tuple[str, int]:
    """Write the upper level, in order, as a file that tasks search; return its path and number of parts.

    It has one line for every ``PART_LINES`` captures, and passes the driver line by line.
    """
    path, n = f"{folder}/{uuid.uuid4().hex}.heads", 0
    files, place = open_path(path)
    files.create_dir(place.rpartition("/")[0], recursive=True)
    with files.open_output_stream(place, compression=None) as out:
        for row in index.orderBy(F.col("url_key").asc(), F.col("page_id").asc_nulls_last(), "part").toLocalIterator():
            out.write((json.dumps(list(row)) + "\n").encode())
            n += 1
    return path, n


def read_heads(path: str) -> list[list]:
    files, place = open_path(path)
    with files.open_input_stream(place, compression=None) as f:
        return [json.loads(x) for x in f.read().splitlines()]


def _read(files: dict, path: str, at: int, size: int) -> bytes:
    if path not in files:
        system, place = open_path(path)
        files[path] = system.open_input_file(place)
    return files[path].read_at(size, at)


def _reader(path: str):
    parts: list[list] = []
    heads: list[tuple] = []

    def captures(wanted: list[tuple[str, int | None]], files: dict) -> Iterator[list]:
        """Captures of sorted keys, each block read once."""
        blocks: dict = {}
        for key, page in wanted:
            k = (key, _rank(page))
            i = max(0, bisect.bisect_left(heads, k) - 1)
            while i < len(parts) and (heads[i] <= k):
                if ("d", i) not in blocks:
                    blocks.clear()
                    blocks["d", i] = json.loads(zlib.decompress(_read(files, parts[i][0], parts[i][3], parts[i][4])))
                sparse = blocks["d", i]
                starts = [(d[0], _rank(d[1])) for d in sparse] if ("s", i) not in blocks else blocks["s", i]
                blocks["s", i] = starts
                b = max(0, bisect.bisect_left(starts, k) - 1)
                while b < len(sparse) and starts[b] <= k:
                    if blocks.get("at") != (i, b):
                        blocks["at"], blocks["lines"] = (i, b), [json.loads(x) for x in zlib.decompress(_read(files, parts[i][0], sparse[b][2], sparse[b][3])).decode().split("\n")]
                        blocks["keys"] = [(x[0], _rank(x[1])) for x in blocks["lines"]]
                    lo, hi = bisect.bisect_left(blocks["keys"], k), bisect.bisect_right(blocks["keys"], k)
                    yield from blocks["lines"][lo:hi]
                    b += 1
                i += 1

    def run(table: pa.Table) -> pa.Table:
        if not parts:  # once in a task
            parts.extend(read_heads(path))
            heads.extend((p[1], _rank(p[2])) for p in parts)
        want = sorted(set(zip(table["url_key"].to_pylist(), table["page_id"].to_pylist(), strict=True)), key=lambda x: (x[0], _rank(x[1])))
        files: dict = {}
        rows = []
        for _, page, archive, offset, length in sorted(captures(want, files), key=lambda x: (x[2], x[3])):
            if len(files) > 64:
                for f in files.values():
                    f.close()
                files.clear()
            fields, payload, http = parse(gzip.decompress(_read(files, archive, offset, length)))
            refers = fields.get("X-Refers-To-Page")
            whole = digest_of(payload) if refers is None else fields["WARC-Payload-Digest"].removeprefix("sha1:")
            rows.append((page, fields["WARC-Target-URI"], int(http["Content-Length"]), whole, fields["WARC-Type"], None if refers is None else int(refers)))
        for f in files.values():
            f.close()
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def _part_of(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = [(p[1], _rank(p[2])) for p in read_heads(path)]
        for batch in batches:
            page, keys = batch.column(0), [url_key(u) for u in batch.column(1).to_pylist()]
            part = [max(0, bisect.bisect_right(heads, (k, _rank(p))) - 1) for k, p in zip(keys, page.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([page, pa.array(keys, pa.string()), pa.array(part, pa.int32())], names=["page_id", "url_key", "part"])

    return run


def lookup(index: DataFrame, requests: DataFrame, folder: str, key: str = "page_id", url: str = "url") -> DataFrame:
    """Records of the requested captures (key, url), read through the index.

    A request that repeats is answered once; a capture written several times is
    returned as often; a request that the index lacks returns nothing.
    """
    heads, parts = write_heads(index, folder)
    wanted = requests.select(F.col(key).alias("page_id"), F.col(url).alias("url")).mapInArrow(_part_of(heads), "page_id long, url_key string, part int")
    # requests are small, so the number of tasks is stated: one for each part
    dealt = wanted.repartition(max(1, min(parts, READERS)), "part")
    return dealt.groupBy("part").applyInArrow(_reader(heads), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_and_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages``, index the archives and read every page back through the index."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    captures = write_archives(pages, folder, least_bytes)
    return lookup(build_index(captures, folder), pages, folder)


#: The rows of op5 in DuckDB's SQL; base32 is spelled out from the hexadecimal digest.
SQL = r"""
WITH p AS (
  SELECT page_id, COALESCE(html, '') AS body FROM pages),
h AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
b AS (
  SELECT *, MAX(page_id) OVER (PARTITION BY hex) AS response,
         array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1) FOR i IN range(32)], '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM b
"""
