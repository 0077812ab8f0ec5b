"""WARC archives of pages, and a two-level index of their captures.

Tasks write and read files through ``pyarrow.fs`` by the URI of the shared folder (file, hdfs, s3, gs). A task that is run again
writes new files under names of its own; only files named by the rows that its last run returned are ever read.
"""

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepbank.session import fresh_path, materialize

# Payloads of fewer bytes are always written out.
MIN_SHARED_BYTES = 100
# An archive is closed once it holds this many compressed bytes.
ARCHIVE_BYTES = 64 << 20
# Index lines to a compressed block, and captures to an index file.
BLOCK_LINES = 512
FILE_LINES = 1 << 20
# Captures of one archive that lie in one span of so many bytes are read together.
SPAN_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def surt(url: str | None) -> str:
    """Sort-friendly form of a URL: reversed host first, lower case, without scheme, user and fragment; '' for none."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"){url}".replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D").replace("\t", "%09")
    if host.startswith("www."):
        host = host[4:]
    at = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in f"{at}){path}".lower())


def capture_key(url: str | None, page_id) -> str:
    """Index key of a capture: its URL's key and its page id in a width that sorts."""
    return f"{surt(url)} {'-' if page_id is None else f'{int(page_id):+021d}'}"


def _clean(url: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record: a response with its HTTP head and payload, or a revisit with the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = "" if page_id is None else page_id
    number = uuid.uuid5(uuid.NAMESPACE_URL, f"page {name} {url} {digest}")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{number}>"), ("WARC-Date", DATE),
        *([("WARC-Target-URI", _clean(url))] if url else []), ("WARC-Payload-Digest", f"sha256:{digest}"),
        *([("WARC-Profile", REVISIT), ("WARC-Refers-To-Page", str(refers_to))] if revisit else []),
        *([("WARC-Page", str(page_id))] if page_id is not None else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a record; raises if its lengths don't fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    length = int(fields["Content-Length"])
    if first != "WARC/1.1" or rest[length:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


CAPTURES = "key string, page_id bigint, archive string, at bigint, length bigint"


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record for every page into gzip-per-record archives under ``folder``; rows (key, page_id, archive, at, length).

    Of pages with equal payloads of at least MIN_SHARED_BYTES bytes, the one with the smallest id is written out, the
    others as revisits of it. The first ids are a pre-aggregated minimum by digest; payloads are not shuffled: each
    task writes the pages that it reads, a record at a time, into archives of its own.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    slim = pages.select(F.col(id_col).cast("bigint").alias("id"), F.sha2(payload, 256).alias("digest"), F.length(payload).alias("n"))
    shared = slim.where(F.col("n") >= MIN_SHARED_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c"))
    shared = materialize(shared.where("c > 1 AND first IS NOT NULL").select(F.col("digest").alias("d"), "first"), "payloads")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    ).join(shared, F.col("digest") == F.col("d"), "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    # Ids go as text, so that nulls don't cost digits.
    rows = rows.select(
        F.col("id").cast("string").alias("id"), "url", "payload", "digest", refers.cast("string").alias("refers_to")
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _open(folder)
        out, name, at = None, "", 0
        for batch in batches:
            found = []
            for key, url, data, digest, refers in batch[["id", "url", "payload", "digest", "refers_to"]].itertuples(index=False):
                key, refers = (None if pd.isna(x) else int(x) for x in (key, refers))
                member = _gzip(record(key, url, bytes(data), digest, refers, refers is not None))
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                found.append((capture_key(url, key), key, name, at, len(member)))
                at += len(member)
            if found:
                yield pd.DataFrame(found, columns=["key", "page_id", "archive", "at", "length"]).astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    # The rows are the record of which files count, so they are fixed before anything reads them.
    return materialize(rows.mapInPandas(write, CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str, file_lines: int = FILE_LINES, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the two levels of the index under ``folder``; rows (file, first_key, lines), one for each index file.

    Captures are sorted by key over range partitions; a partition becomes an index file of compressed blocks of
    ``block_lines`` lines, followed by its sparse directory: the first key, place and length of each block. The rows
    returned are the top of the index; there are as many as files, a millionth of the captures.
    """
    spark = captures.sparkSession
    n = captures.count()
    parts = max(1, -(-n // file_lines), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // block_lines)))
    ordered = captures.repartitionByRange(parts, "key", "archive", "at").sortWithinPartitions("key", "archive", "at")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _open(folder)
        out, name, at, waiting, directory, total = None, "", 0, [], [], 0

        def close_block():
            nonlocal at, waiting
            data = zlib.compress("\n".join(waiting).encode())
            out.write(data)
            directory.append(f"{waiting[0].split(' ', 2)[0]} {waiting[0].split(' ', 2)[1]} {at} {len(data)}")
            at += len(data)
            waiting = []

        for batch in batches:
            for key, archive, start, length in batch[["key", "archive", "at", "length"]].itertuples(index=False):
                if out is None:
                    name = f"{uuid.uuid4().hex}.idx"
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                waiting.append(f"{key} {archive} {start} {length}")
                total += 1
                if len(waiting) >= block_lines:
                    close_block()
        if out is not None:
            if waiting:
                close_block()
            data = zlib.compress("\n".join(directory).encode())
            out.write(data + len(data).to_bytes(8, "big"))
            out.close()
            first = " ".join(directory[0].split(" ")[:2])
            yield pd.DataFrame([(name, first, total)], columns=["file", "first_key", "lines"])

    return materialize(ordered.mapInPandas(write, "file string, first_key string, lines bigint"), "index")


class _IndexFile:
    """An open index file: its directory, and the last block read."""

    def __init__(self, files, path: str):
        self.handle = files.open_input_file(path)
        end = self.handle.size()
        size = int.from_bytes(self._range(end - 8, 8), "big")
        lines = zlib.decompress(self._range(end - 8 - size, size)).decode().split("\n")
        parts = [x.rsplit(" ", 2) for x in lines]
        self.firsts = [x[0] for x in parts]
        self.places = [(int(x[1]), int(x[2])) for x in parts]
        self.last: tuple[int, list[str]] = (-1, [])

    def _range(self, at: int, length: int) -> bytes:
        self.handle.seek(at)
        return self.handle.read(length)

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(archive, at, length) of each capture of a key; blocks are found by binary search in the directory."""
        block = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while block < len(self.firsts) and self.firsts[block] <= key:
            if self.last[0] != block:
                self.last = (block, zlib.decompress(self._range(*self.places[block])).decode().split("\n"))
            lines = self.last[1]
            for i in range(bisect.bisect_left(lines, f"{key} "), len(lines)):
                if not lines[i].startswith(f"{key} "):
                    break
                archive, at, length = lines[i].rsplit(" ", 3)[1:]
                yield archive, int(at), int(length)
            block += 1


def look_up(wanted: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """Captures (key, archive, at, length) of the keys in ``wanted`` (column key, each once).

    The first keys of the index files, sorted, say which files may hold a key. These go with the job: one line to a file of about a
    million captures. Keys of one file are sorted and searched in its directory, and only blocks that may hold one are read.
    """
    top = sorted((r["first_key"], r["file"]) for r in index.collect())
    firsts = [k for k, _ in top]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key in batch["key"]:
                # Captures of one key may go on from file to file.
                low, high = max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)
                rows += [(key, i) for i in range(low, high)]
            yield pd.DataFrame(rows, columns=["key", "file"]).astype({"file": "int64"})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _open(folder)
        current, opened = -1, None
        for batch in batches:
            rows = []
            for key, number in zip(batch["key"], batch["file"], strict=True):
                if number != current:
                    current, opened = number, _IndexFile(files, f"{base}/{top[number][1]}")
                rows += [(key, *place) for place in opened.find(key)]
            yield pd.DataFrame(rows, columns=["key", "archive", "at", "length"]).astype({"at": "int64", "length": "int64"})

    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = wanted.select("key").mapInPandas(route, "key string, file bigint")
    routed = routed.repartition(n, "file").sortWithinPartitions("file", "key")
    return routed.mapInPandas(search, "key string, archive string, at bigint, length bigint")


RECORDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()),
])


def read_records(captures: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records at the given places (archive, at, length): range reads, in order of place within each span of an archive.

    The payload of a response is read whole and its digest computed and held against the record's; a revisit states the
    length and digest of the payload that it stands for. ``payloads`` adds the payload itself (null for a revisit).
    """
    schema = T.StructType([*RECORDS.fields, *([T.StructField("payload", T.BinaryType())] * payloads)])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _open(folder)
        current, handle = None, None
        for batch in batches:
            rows = []
            for archive, at, length in zip(batch["archive"], batch["at"], batch["length"], strict=True):
                if archive != current:
                    current, handle = archive, files.open_input_file(f"{base}/{archive}")
                handle.seek(int(at))
                fields, http, payload = parse(_gunzip(handle.read(int(length))))
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError("a payload does not have its record's digest")
                page = fields.get("WARC-Page")
                rows.append((
                    None if page is None else int(page), fields.get("WARC-Target-URI"), int(http["Content-Length"]), digest, kind,
                    int(fields["WARC-Refers-To-Page"]) if kind == "revisit" else None,
                    *([payload if kind == "response" else None] * payloads),
                ))
            out = pd.DataFrame(rows, columns=schema.names)
            yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = captures.withColumn("span", F.floor(F.col("at") / SPAN_BYTES))
    ordered = spans.repartition(n, "archive", "span").sortWithinPartitions("archive", "at")
    return ordered.select("archive", "at", "length").mapInPandas(read, schema)


def archive_round_trip(
    spark: SparkSession, pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write all pages, index them, look every capture up and read it back: one row per page, as ``read_records`` gives it.

    A null html is an empty payload; a null url has the key '' and no target field; a null id has no page field and is
    never the one that others revisit; rows that share id and payload are all written out if they are the first;
    repeated rows are captures of their own; an empty table gives an empty result; other columns take no part.
    """
    folder = folder or fresh_path(spark, "warc")
    captures = write_archives(pages, f"{folder}/archives", id_col, url_col, html_col)
    index = write_index(captures, f"{folder}/index")
    found = look_up(captures.select("key").distinct(), index, f"{folder}/index")
    return read_records(found, f"{folder}/archives")
