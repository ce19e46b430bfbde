"""WARC archives of pages and their globally ordered capture index.

``write_archives`` writes one gzip member per record (response or revisit) into
size-bounded ``.warc.gz`` files.  ``index_archives`` reads them back record by
record; each archive's captures, sorted by URL key, timestamp and record id, form one
*run*: a file of compressed blocks of index lines with one sparse row (first
and last key, place) per block.  ``merge_runs`` merges runs externally: groups
of about ``fan_in`` runs are cut into key ranges by their sparse rows, and each
range is one task that streams its slices of the runs through a loser tree into
a new file.  Passes repeat until one run is left: the capture histories in
global order, a range per file.  A URL captured a billion times is cut into
ranges by timestamp and record id like any other stretch of the key space.

Edge cases: a null page is an empty payload; a null url has the key ``-``; a
null page_id sorts first and is smaller than every other; rows that share the
largest page_id and the payload are all responses; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dxlens.llm.common import RangeReader, Scratch, TaskFile, batched, open_fs, records

ARCHIVE_BYTES = 16 << 20
ARCHIVE_RECORDS = 20_000
BLOCK_LINES = 2048
BLOCKS_PER_RANGE = 16
FAN_IN = 64
EPOCH = dt.datetime(2020, 1, 1)
# characters that a URL keeps as they are in a header or an index line
URL_SAFE = "!#$%&'()*+,-./:;=?@[]_~"

BLOCK_FIELDS = "run string, seq long, file string, offset long, length long, n long, first binary, last binary"
BLOCK_SCHEMA = pa.schema([("run", pa.string()), ("seq", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
                          ("length", pa.int64()), ("n", pa.int64()), ("first", pa.binary()), ("last", pa.binary())])
CAPTURE_FIELDS = ("urlkey string, timestamp string, page_id long, url string, payload_bytes long, payload_digest string, "
                  "record_type string, refers_to long, archive string, offset long")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: ``http://a.example.org/x?y`` -> ``org,example,a)/x?y``."""
    if not url:
        return "-"
    safe = quote(url.strip(), safe=URL_SAFE)
    try:
        parts = urlsplit(safe if "://" in safe else f"http://{safe}")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return safe
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def capture_time(page_id: int | None) -> dt.datetime:
    """Pages carry no capture time: one second per page_id from a fixed day, within a century."""
    return EPOCH + dt.timedelta(seconds=(page_id or 0) % (100 * 365 * 86400))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def parse_record_id(text: str) -> int | None:
    number = text.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Date: {capture_time(page_id):%Y-%m-%dT%H:%M:%SZ}",
            f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=URL_SAFE)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_id(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, rest


def decode_record(data: bytes) -> dict:
    """The capture that a record describes; a response's digest and length come from its payload."""
    head, rest = _headers(data)
    http, payload = _headers(rest[:int(head["content-length"])])
    response = head["warc-type"] == "response"
    if response and len(payload) != int(http["content-length"]):
        raise ValueError(f"damaged record {head['warc-record-id']}")
    url = head.get("warc-target-uri")
    return {"urlkey": url_key(url), "timestamp": "".join(c for c in head["warc-date"] if c.isdigit()),
            "page_id": parse_record_id(head["warc-record-id"]), "url": url,
            "payload_bytes": len(payload) if response else int(http["content-length"]),
            "payload_digest": payload_digest(payload) if response else head["warc-payload-digest"].removeprefix("sha1:"),
            "record_type": head["warc-type"],
            "refers_to": None if response else parse_record_id(head["warc-refers-to"])}


def read_members(uri: str, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a file, read as a stream."""
    filesystem, path = open_fs(uri)
    with filesystem.open_input_stream(path, compression=None) as stream:
        offset, data = 0, stream.read(chunk)
        while data:
            unzip, parts, used = zlib.decompressobj(31), [], 0
            while not unzip.eof:
                if not data:
                    data = stream.read(chunk)
                    if not data:
                        raise ValueError(f"{uri} ends inside a record")
                parts.append(unzip.decompress(data))
                used += len(data) - len(unzip.unused_data)
                data = unzip.unused_data
            yield offset, b"".join(parts)
            offset += used
            data = data or stream.read(chunk)


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html); returns (archive, records) once evaluated.

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes, the one with the
    largest page_id is the response and the others revisit it.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                         F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("sha", F.when(F.length("payload") >= min_revisit_bytes, F.sha2("payload", 256)))
    repeated = (pages.where("sha IS NOT NULL").groupBy("sha")
                .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    first = F.col("response_id").isNull() | F.col("response_id").eqNullSafe(F.col("page_id"))
    roles = pages.join(repeated, "sha", "left").select(
        "page_id", "url", "payload", F.when(first, "response").otherwise("revisit").alias("kind"),
        F.when(~first, F.col("response_id")).alias("refers_to"))

    schema = pa.schema([("archive", pa.string()), ("records", pa.int64())])

    def run(batches):
        def archives():
            file, count = None, 0
            for page_id, url, payload, kind, refers_to in records(batches):
                if file is None:
                    file, count = TaskFile(folder, "capture", ".warc.gz"), 0
                zipper = zlib.compressobj(1, zlib.DEFLATED, 31)
                file.write(zipper.compress(encode_record(page_id, url, payload, kind, refers_to)) + zipper.flush())
                count += 1
                if file.size >= archive_bytes or count >= archive_records:
                    file.close()
                    yield file.uri, count
                    file = None
            if file is not None:
                file.close()
                yield file.uri, count
        yield from batched(archives(), schema)

    return roles.mapInArrow(run, "archive string, records long")


def _line(capture: dict) -> bytes:
    """``urlkey timestamp record json``; the first three parts sort as bytes."""
    page = capture["page_id"]
    order = "-" if page is None else f"{page + (1 << 63):020d}"
    return f"{capture['urlkey']} {capture['timestamp']} {order} {json.dumps(capture, separators=(',', ':'))}".encode()


def _key(line: bytes) -> bytes:
    return line[:line.index(b" {")]


class BlockWriter:
    """Writes sorted lines as compressed blocks and yields the sparse row of each."""

    def __init__(self, folder: str, run: str, seq: int = 0):
        self.file, self.run, self.seq, self.lines = TaskFile(folder, "run"), run, seq, []

    def add(self, line: bytes) -> Iterator[tuple]:
        self.lines.append(line)
        if len(self.lines) >= BLOCK_LINES:
            yield self._flush()

    def finish(self) -> Iterator[tuple]:
        if self.lines:
            yield self._flush()
        self.file.close()

    def _flush(self) -> tuple:
        data = zlib.compress(b"\n".join(self.lines), 1)
        row = (self.run, self.seq, self.file.uri, self.file.write(data), len(data), len(self.lines),
               _key(self.lines[0]), _key(self.lines[-1]))
        self.seq, self.lines = self.seq + 1, []
        return row


def index_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Read every archive back; each becomes one sorted run. Returns the sparse rows of its blocks."""

    def run(batches):
        def blocks():
            for (uri,) in records(batches):
                lines = sorted(_line(decode_record(data) | {"archive": uri, "offset": at}) for at, data in read_members(uri))
                writer = BlockWriter(folder, uri.rpartition("/")[2])
                for line in lines:
                    yield from writer.add(line)
                yield from writer.finish()
        yield from batched(blocks(), BLOCK_SCHEMA)

    return archives.select("archive").mapInArrow(run, BLOCK_FIELDS)


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so the next line costs log2(k) comparisons."""

    def __init__(self, sources: list[Iterator[bytes]]):
        self.sources = sources
        self.heads = [next(s, None) for s in sources]
        self.k = len(sources)
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) >> 1
        while node:
            other = self.tree[node]
            if other < 0:  # first visit while the tree fills: wait for an opponent
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node >>= 1
        self.tree[0] = winner

    def __iter__(self) -> Iterator[bytes]:
        while self.k:
            best = self.tree[0]
            if self.heads[best] is None:
                return
            yield self.heads[best]
            self.heads[best] = next(self.sources[best], None)
            self._replay(best)


def _slice(blocks: list[dict], low: bytes, high: bytes | None) -> Iterator[bytes]:
    """The lines of one run with low <= key < high, block by block."""
    reader = RangeReader()
    for b in blocks:
        for line in zlib.decompress(reader.read(b["file"], b["offset"], b["length"])).split(b"\n"):
            key = _key(line)
            if high is not None and key >= high:
                reader.close()
                return
            if key >= low:
                yield line
    reader.close()


def _ranges(blocks_per_range: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def cut(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values(["run", "seq"])
        firsts = sorted(set(blocks["first"]))
        lows = firsts[::blocks_per_range]
        rows = []
        for i, low in enumerate(lows):
            high = lows[i + 1] if i + 1 < len(lows) else None
            here = blocks[(blocks["last"] >= low) & ((blocks["first"] < high) if high is not None else True)]
            rows.append((blocks["part"].iloc[0], i, low, high, here[["run", "file", "offset", "length"]].to_dict("records")))
        return pd.DataFrame(rows, columns=["part", "range", "low", "high", "blocks"])
    return cut


def merge_runs(blocks: DataFrame, scratch: Scratch, fan_in: int = FAN_IN,
               blocks_per_range: int = BLOCKS_PER_RANGE) -> DataFrame:
    """Merge the runs of a stored ``blocks`` table into one; returns its sparse rows, ``seq`` giving the global order.

    A planning task sees the sparse rows of one group only (one row per 2048 captures),
    a merging task streams one range: about ``blocks_per_range`` blocks of lines.
    """
    runs = blocks.select("run").distinct().count()
    level = 0
    while runs > 1:
        groups = -(-runs // fan_in)
        part = F.pmod(F.xxhash64("run"), F.lit(groups))
        ranges = (blocks.withColumn("part", part).groupBy("part").applyInPandas(
            _ranges(blocks_per_range),
            "part long, range long, low binary, high binary, blocks array<struct<run:string,file:string,offset:long,length:long>>"))
        ranges = scratch.table(ranges, f"ranges{level}")
        folder, tag = scratch.path(f"merged{level}"), f"level{level}"

        def run(batches):
            def merged():
                for part, number, low, high, parts in records(batches):
                    slices: dict[str, list[dict]] = {}
                    for b in parts:
                        slices.setdefault(b["run"], []).append(b)
                    writer = BlockWriter(folder, f"{tag}-{part}", number << 32)
                    for line in LoserTree([_slice(v, low, high) for v in slices.values()]):
                        yield from writer.add(line)
                    yield from writer.finish()
            yield from batched(merged(), BLOCK_SCHEMA, size=64)

        tasks = max(1, min(ranges.count(), 4 * blocks.sparkSession.sparkContext.defaultParallelism))
        blocks = scratch.table(ranges.repartition(tasks, "part", "range").mapInArrow(run, BLOCK_FIELDS), f"blocks{level}")
        runs, level = blocks.select("run").distinct().count(), level + 1
    return blocks


def captures(blocks: DataFrame) -> DataFrame:
    """The captures of a run, ordered within each block."""

    def run(batches):
        reader = RangeReader()
        for batch in batches:
            for row in batch.to_pylist():
                data = zlib.decompress(reader.read(row["file"], row["offset"], row["length"]))
                found = pd.DataFrame([json.loads(x[x.index(b" {") + 1:]) for x in data.split(b"\n")])
                yield pa.RecordBatch.from_pandas(found, schema=CAPTURE_SCHEMA, preserve_index=False)
        reader.close()

    return blocks.mapInArrow(run, CAPTURE_FIELDS)


CAPTURE_SCHEMA = pa.schema([(name, pa.int64() if kind == "long" else pa.string())
                            for name, kind in (x.split(" ") for x in CAPTURE_FIELDS.split(", "))])


def archive_and_index(pages: DataFrame, min_revisit_bytes: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """Write the archives, read them back and return the globally ordered captures."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    archives = scratch.table(write_archives(pages, scratch.path("archives"), min_revisit_bytes), "manifest")
    tasks = max(1, min(archives.count(), 4 * spark.sparkContext.defaultParallelism))
    blocks = scratch.table(index_archives(archives.repartition(tasks, "archive"), scratch.path("runs")), "blocks")
    return captures(merge_runs(blocks, scratch, fan_in))
