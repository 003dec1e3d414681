"""WARC archives and a two-level capture index.

Pages are written as WARC 1.1 records, one gzip member each, in archive files of bounded size
below the shared folder. Of records with equal payloads of at least MIN_REVISIT bytes, that
with the smallest page_id is a response and the others revisit it.

The index has two levels. Captures are sorted by key, the URL with its host reversed, and
written as lines in gzip blocks of BLOCK_LINES; the sparse directory keeps each block's first
and last key, file and range. A lookup finds a key's index files by bisection among the files' ends,
which are few, and its blocks by bisection in those files' parts of the directory. Then the blocks are
dealt out by their number of records' bytes; each is read by its range, and its records by theirs, a
few at a time. A key that holds most captures has many blocks, so it is many tasks.

Files are written through pyarrow's file systems, named by a random id, and known only from
the rows that a finished task returns: a task that is run again leaves a file that nobody reads.

Defined results: a null html is an empty payload, a null url has the key "-". Repeated page_ids
make a record each; rows with the response's page_id are responses too. Rows without page_id
are written without it and may revisit, but are not revisited unless they stand alone. Other
columns of the input are ignored. An empty table writes no files and reads back no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm.common import fresh_path, staged

#: smaller payloads are never revisited
MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 1000
#: captures of an index file, and files at most: beyond that these grow
FILE_LINES, MAX_FILES = 500_000, 1 << 16
#: code points of a key by which index files are told apart
END_CHARS = 200
#: bytes of archives that a reading task takes, and records that it holds
TASK_BYTES, HELD_RECORDS = 32 << 20, 200
WRITTEN = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"

CAPTURE = "key string, page_id long, file string, offset long, length long"
DIRECTORY = "first string, last string, file string, offset long, length long, lines long, bytes long"
BLOCK = "file string, offset long, length long, bytes long, keys array<string>"
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, payload binary")


def url_key(url: str | None) -> str:
    """Host labels in reverse, then ")" and what follows; without white space or control signs."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        host = None
    if not host:
        return quote(url.strip().lower(), safe="!#$&'()*+,/:;=?@[]%~") or "-"
    labels = host.split(".")
    labels = [w for w in (labels[1:] if labels[0] == "www" and len(labels) > 2 else labels) if w]
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    port = f":{port}" if port and port not in (80, 443) else ""
    return quote(",".join(reversed(labels)) + port + ")" + rest.lower(), safe="!#$&'()*+,/:;=?@[]%~")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, first: int | None) -> bytes:
    """A response record, or with ``first`` a record that revisits that page's."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block = http if first is not None else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>",
            f"WARC-Date: {WRITTEN}", f"WARC-Target-URI: {quote(url or 'urn:none', safe=_SAFE)}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if first is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-Id: {first}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + _END + block + _END


_SAFE = "!#$&'()*+,/:;=?@[]%~ "


def parsed(raw: bytes) -> dict:
    """A record's fields; a payload that doesn't have the digest of its header is an error."""
    head, _, rest = raw.partition(_END)
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    length = int(fields["Content-Length"])
    block = rest[:length]
    if lines[0] != "WARC/1.1" or len(block) != length or rest[length:] != _END:
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(_END)
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload and digest differ")

    def number(name: str) -> int | None:
        return int(fields[name]) if name in fields else None

    return {"page_id": number("X-Page-Id"), "url": fields["WARC-Target-URI"], "payload_bytes": size,
            "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"),
            "payload": payload if kind == "response" else None}


class Files:
    """Opens files below a folder that every executor sees; keeps a few open for range reads."""

    def __init__(self, root: str):
        if "://" in root or root.startswith("file:"):
            self.fs, self.root = pyarrow.fs.FileSystem.from_uri(root)
        else:
            self.fs, self.root = pyarrow.fs.LocalFileSystem(), root
        self.fs.create_dir(self.root, recursive=True)
        self.open: dict[str, pyarrow.NativeFile] = {}

    def create(self, ending: str) -> tuple[str, pyarrow.NativeFile]:
        name = f"{uuid.uuid4().hex}{ending}"
        return name, self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.root}/{name}")
        return self.open[name].read_at(length, offset)


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``root``; returns the captures."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")) \
        .withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    # only payloads that occur more than once need to be looked up
    firsts = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest") \
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL") \
        .select("digest", "first")
    marked = rows.join(firsts, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = marked.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", "size",
                        F.when(again, F.col("first")).cast("long").alias("first"))

    def number(x) -> int | None:
        return None if pd.isna(x) else int(x)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, name, stream, at = None, "", None, 0
        for b in batches:
            made = []
            for page_id, url, payload, digest, size, first in b.itertuples(index=False):
                if stream is None:
                    files = files or Files(root)
                    (name, stream), at = files.create(".warc.gz"), 0
                member = gzip.compress(record(number(page_id), url, payload, digest, size, number(first)), 6, mtime=0)
                stream.write(member)
                made.append((url_key(url), number(page_id), name, at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    stream.close()
                    stream = None
            yield _frame(made, CAPTURE)
        if stream is not None:
            stream.close()

    return staged(out.mapInPandas(write, CAPTURE), "captures")


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


def write_index(captures: DataFrame, root: str) -> DataFrame:
    """Write the captures, sorted by key, in blocks below ``root``; returns the directory."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, stream, at, size = "", None, 0, 0
        made, lines = [], []

        def flush() -> None:
            nonlocal at, lines, size
            block = gzip.compress("".join(f"{k} {rest}\n" for k, rest in lines).encode(), 6, mtime=0)
            stream.write(block)
            made.append((lines[0][0], lines[-1][0], name, at, len(block), len(lines), size))
            at, lines, size = at + len(block), [], 0

        for b in batches:
            for key, page_id, file, offset, length in b.itertuples(index=False):
                if stream is None:
                    name, stream = Files(root).create(".cdx.gz")
                rest = [None if pd.isna(page_id) else int(page_id), file, int(offset), int(length)]
                lines.append((key, json.dumps(rest)))
                size += int(length)
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if stream is not None:
            stream.close()
        if made:
            yield _frame(made, DIRECTORY)

    files = min(MAX_FILES, -(-captures.count() // FILE_LINES))
    ordered = captures.repartitionByRange(max(1, files), "key", "page_id").sortWithinPartitions("key", "page_id")
    return staged(ordered.mapInPandas(write, DIRECTORY), "directory")


def _captures(files: Files, file: str, offset: int, length: int) -> list[tuple]:
    """The captures of one index block: (key, page_id, file, offset, length)."""
    text = gzip.decompress(files.read(file, offset, length)).decode()
    return [(key, *json.loads(rest)) for key, rest in (x.split(" ", 1) for x in text.splitlines())]


def _records(files: Files, captures: list[tuple]) -> list[tuple]:
    out = []
    for *_, file, offset, length in sorted(captures, key=lambda c: (c[2], c[3])):
        found = parsed(gzip.decompress(files.read(file, offset, length)))
        out.append(tuple(found[c.split()[0]] for c in RECORD.split(", ")))
    return out


def _files_of(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """(key, of): the index files that can hold each key. Files cover ranges of keys that meet at their ends."""
    ends = directory.groupBy("file").agg(F.min(F.substring("first", 1, END_CHARS)).alias("lo"),
                                         F.max(F.substring("last", 1, END_CHARS)).alias("hi")).collect()  # MAX_FILES at most
    ends.sort(key=lambda r: (r["lo"], r["hi"]))
    shared = keys.sparkSession.sparkContext.broadcast(tuple([r[c] for r in ends] for c in ("lo", "hi", "file")))

    @F.pandas_udf("array<string>")
    def files(keys: pd.Series) -> pd.Series:
        lo, hi, names = shared.value
        return keys.str.slice(0, END_CHARS).map(lambda k: names[bisect_left(hi, k):bisect_right(lo, k)])

    return keys.select("key", F.explode(files("key")).alias("of"))


def lookup(urls: DataFrame, directory: DataFrame, archives: str, index: str) -> DataFrame:
    """The records of ``urls`` (url), by their keys; one row for each distinct key and record."""
    keys = urls.select(F.pandas_udf(lambda s: s.map(url_key), "string")("url").alias("key")).distinct()

    def search(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("offset")
        first, last = blocks["first"].tolist(), blocks["last"].tolist()
        wanted: dict[int, list[str]] = {}
        for key in asked["key"]:
            for k in range(bisect_left(last, key), bisect_right(first, key)):
                wanted.setdefault(k, []).append(key)
        found = blocks.iloc[list(wanted)]
        return pd.DataFrame({c: found[c] for c in ("file", "offset", "length", "bytes")} | {"keys": list(wanted.values())})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = records = None
        for b in batches:
            for file, offset, length, some in b[["file", "offset", "length", "keys"]].itertuples(index=False):
                blocks, records, some = blocks or Files(index), records or Files(archives), set(some)
                found = [c for c in _captures(blocks, file, offset, length) if c[0] in some]
                for k in range(0, len(found), HELD_RECORDS):
                    yield _frame(_records(records, found[k:k + HELD_RECORDS]), RECORD)

    asked = _files_of(keys, directory)
    blocks = staged(asked.groupBy("of").cogroup(directory.groupBy("file")).applyInPandas(search, BLOCK), "blocks")
    size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(urls.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return blocks.repartition(tasks, "file", "offset").mapInPandas(read, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages``, index them, and look all their URLs up again."""
    root = fresh_path(spark, "warc")
    directory = write_index(write_archives(pages, f"{root}/archives"), f"{root}/index")
    return lookup(pages.select("url"), directory, f"{root}/archives", f"{root}/index")


#: the same rows in DuckDB's SQL
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(OCTET_LENGTH(ENCODE(h)) AS BIGINT) AS n, SHA256(h) AS d FROM p),
f AS (SELECT d, MIN(page_id) AS m FROM q WHERE n >= {MIN_REVISIT} GROUP BY d)
SELECT page_id, n AS payload_bytes, q.d AS payload_digest,
       CASE WHEN m IS NULL OR page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> m THEN m END AS refers_to
FROM q LEFT JOIN f ON q.d = f.d
"""
