"""WARC archives with a two-level capture index.

Records go out through Spark's text writer, whose line separator is the blank lines that
end a record, so archives land on whatever file system the session uses and are ordinary
uncompressed WARC files. Payloads are shuffled only where they may be repeated, one copy a
task; revisits carry none.

The index sorts reversed-host URL keys by range and packs them into zlib-compressed
blocks. Its directory is sparse, one entry a block, and itself sorted by range; above it
stands one entry a range, and only this top level (as many entries as the sort had
partitions) is broadcast. Lookups are a join: a URL's ranges by binary search in the top
level, its blocks by binary search in the directory of the range, its captures by binary
search in the block, and then only the byte ranges of the captures are read, by the tasks,
through Arrow's file systems (local, HDFS, S3, GCS, ABFS).

Defined cases: a null html is an empty payload; payloads of at least ``REVISIT_BYTES``
bytes that are equal have one response, the row with the largest page_id (a null page_id
counts as smallest; rows that share it are all responses), and revisits of it; a null
url is the empty URL and line breaks in a URL are blanks; other columns are ignored, an
empty table gives an empty archive and no rows; a long payload is read on its own.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import bit_map, flagged
from .staging import fresh_path, stage

REVISIT_BYTES, BLOCK_LINES, FILE_BYTES, READ_BYTES = 1000, 512, 16 << 20, 4 << 20
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "page_id long, record_type string, file string, offset long, length long"
SCHEMA = "page_id long, url string, record_type string, refers_to long, digest string, payload binary, file string, offset long, length long"


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))


def target_uri(url: Column) -> Column:
    """A URL as it stands in a header."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", " ")


def record(date: str = DATE) -> Column:
    """The text of a WARC record without the blank lines that end it."""
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    empty = F.lit("")
    return F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", uri("page_id")), _line("WARC-Date", date),
        _line("WARC-Target-URI", target_uri(F.col("url"))), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), _line("WARC-Refers-To", uri("refers_to")))).otherwise(empty),
        _line("Content-Type", "text/html; charset=utf-8"), _line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body)


def write(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """One record per page, in files of about ``file_bytes`` at most.

    Payloads that no other row has are written where they are read. Whether one may be
    repeated is told by a bit map of digests; of those that may, one copy a task is
    gathered by digest, and who is response or revisit is settled without payloads.
    """
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    sized = sized.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    narrow = stage(sized.select("page_id", "url", "digest", "size"), "pages")
    large = F.col("size") >= REVISIT_BYTES
    bits = bit_map(narrow.where(large).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "digest")
    rows, slim = (flagged(df, bits, [F.col("digest")], "maybe") for df in (sized, narrow))
    alone = rows.where(~(F.col("maybe") & large)).select("page_id", "url", "html", "digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))

    responses = slim.where(F.col("maybe") & large).groupBy("digest", "size").agg(F.max("page_id").alias("response"))
    typed = slim.where(F.col("maybe") & large).join(responses, ["digest", "size"]).withColumn("again", ~F.col("page_id").eqNullSafe(F.col("response")) & F.col("response").isNotNull())
    typed = stage(typed.select("page_id", "url", "digest", "size", "response", "again"), "typed")
    payloads = rows.where(F.col("maybe") & large).groupBy("digest", "size").agg(F.max("html").alias("html"))
    first = typed.where("NOT again").join(payloads, ["digest", "size"]).select("page_id", "url", "html", "digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    later = typed.where("again").select("page_id", "url", F.lit("").alias("html"), "digest", F.lit("revisit").alias("record_type"), F.col("response").alias("refers_to"))

    mean = narrow.agg(F.avg(F.col("size") + F.octet_length("url") + 400)).first()[0] or 1
    alone.union(first).union(later).select(record().alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", max(1, int(file_bytes / mean))).text(path)


def _headers(raw: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in raw.decode().split("\r\n")[1:])


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, payload, offset and length of each record of an archive."""
    at = 0
    while at < len(content):
        if not content.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        split = content.index(b"\r\n\r\n", at)
        headers = _headers(content[at:split])
        start = split + 4
        end = start + int(headers["Content-Length"])
        yield headers, content[start:end], at, end + len(END) - at
        at = end + len(END)


def _id(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """url and the ``CAPTURE`` columns of every record of the archives below ``path``; files are gone through as streams, payloads are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("url", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            for file in batch.column("path").to_pylist():
                system, name = _opened(file)
                rows, held, at = [], b"", 0
                with system.open_input_stream(name, buffer_size=1 << 20) as stream:
                    while True:
                        while (split := held.find(b"\r\n\r\n")) < 0 and (more := stream.read(1 << 16)):
                            held += more
                        if split < 0:
                            if held:
                                raise ValueError(f"{file}: no WARC record at byte {at}")
                            break
                        h = _headers(held[:split])
                        length = split + 4 + int(h["Content-Length"]) + len(END)
                        rows.append((h["WARC-Target-URI"], _id(h["WARC-Record-ID"]), h["WARC-Type"], file, at, length))
                        left = length - len(held)
                        held = held[length:] if left < 0 else b""
                        while left > 0 and (more := stream.read(min(left, 1 << 20))):
                            left -= len(more)
                        at += length
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path").mapInArrow(run, f"url string, {CAPTURE}")


def url_key(url: Column) -> Column:
    """Reversed host, then port, path and query: ``http://me@b.a.org:8080/X#y`` gives ``org,a,b):8080/X``.

    Scheme, user and fragment are left out; hosts that are addresses are not reversed.
    """
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    site = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), r"^.*@", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    port = F.regexp_extract(site, r":[0-9]*$", 0)
    host = F.lower(F.regexp_replace(site, r":[0-9]*$", ""))
    address = host.rlike(r"^(?:[0-9]+\.){3}[0-9]+$|^\[")
    turned = F.when(address, host).otherwise(F.array_join(F.reverse(F.split(host, r"\.")), ","))
    return F.concat(turned, F.lit(")"), F.when(F.length(port) > 1, port).otherwise(F.lit("")), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)))


def build_index(found: DataFrame, path: str, block_lines: int = BLOCK_LINES, ranges: int | None = None) -> None:
    """Write the blocks and the directory of (url, page_id, record_type, file, offset, length) rows, in ``ranges`` or as many as the session sees fit."""
    names = ["k", "page_id", "record_type", "file", "offset", "length"]
    order = ["k", "page_id", "file", "offset"]
    ordered = found.select(url_key(target_uri(F.col("url"))).alias("k"), *names[1:]).repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    fields = ["part", "block", "first_key", "last_key", "lines", "data"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, part = [], 0, 0

        def block() -> pa.RecordBatch:
            raw = "\n".join(json.dumps(x) for x in held).encode()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([held[0][0]]), pa.array([held[-1][0]]), pa.array([len(held)], pa.int64()), pa.array([zlib.compress(raw)], pa.binary())], names=fields)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*names, "part")), strict=True):
                part = row[-1]
                held.append(row[:-1])
                if len(held) == block_lines:
                    yield block()
                    held, number = [], number + 1
        if held:
            yield block()

    ordered.mapInArrow(pack, "part int, block long, first_key string, last_key string, lines long, data binary").write.parquet(f"{path}/blocks")
    found.sparkSession.read.parquet(f"{path}/blocks").select("part", "block", "first_key", "last_key").write.parquet(f"{path}/directory")


class CaptureIndex:
    """Lookups of many URLs at once; the driver holds one entry a range of the sort."""

    def __init__(self, spark: SparkSession, path: str):
        self.blocks, self.directory = (spark.read.parquet(f"{path}/{x}") for x in ("blocks", "directory"))
        self.top = sorted((r["a"], r["z"], r["part"]) for r in self.directory.groupBy("part").agg(F.min("first_key").alias("a"), F.max("last_key").alias("z")).collect())

    def captures(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """k (the URL key) and the ``CAPTURE`` columns of every capture of the URLs, each once."""
        top = urls.sparkSession.sparkContext.broadcast(([t[0].encode() for t in self.top], [t[1].encode() for t in self.top], [t[2] for t in self.top]))

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, last, parts = top.value
            for batch in batches:
                out = []
                for k in batch.column("k").to_pylist():
                    raw = k.encode()
                    out += [(parts[p], k) for p in range(bisect_left(last, raw), bisect_right(first, raw))]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.string())], names=["part", "k"])

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mark, numbers, first, last = None, [], [], []
            for batch in batches:
                out = []
                for part, block, a, z in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "first_key", "last_key")), strict=True):
                    if part != mark:
                        mark, numbers, first, last = part, [], [], []
                    if block >= 0:
                        numbers.append(block)
                        first.append(a.encode())
                        last.append(z.encode())
                    else:
                        raw = a.encode()
                        out += [(part, numbers[b], a) for b in range(bisect_left(last, raw), bisect_right(first, raw))]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string()))], names=["part", "block", "k"])

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            for batch in batches:
                out = []
                for data, keys in zip(batch.column("data").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                    lines = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
                    own = [x[0].encode() for x in lines]
                    for k in keys:
                        out += lines[bisect_left(own, k.encode()) : bisect_right(own, k.encode())]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["k", "page_id", "record_type", "file", "offset", "length"])

        keys = urls.select(url_key(target_uri(F.col(url))).alias("k")).distinct().mapInArrow(ranges, "part int, k string")
        asked = keys.select("part", F.lit(-1).cast("long").alias("block"), F.col("k").alias("first_key"), F.col("k").alias("last_key"))
        # a range's directory comes before the keys that are looked up in it
        both = self.directory.select(*asked.columns).unionByName(asked).repartition("part").sortWithinPartitions("part", F.col("block") < 0, "block", "first_key")
        wanted = both.mapInArrow(blocks, "part int, block long, k string").groupBy("part", "block").agg(F.collect_list("k").alias("keys"))
        return self.blocks.join(wanted, ["part", "block"]).select("data", "keys").mapInArrow(unpack, f"k string, {CAPTURE}")


def fetch(found: DataFrame) -> DataFrame:
    """The ``SCHEMA`` columns of (file, offset, length) captures: adjacent ranges are read as one, ``READ_BYTES`` at a time."""
    near = F.floor(F.col("offset") / (2 * READ_BYTES))
    placed = found.select("file", "offset", "length").repartition("file", near).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        opened, name = None, None

        def read(file: str, spans: list[tuple[int, int]]) -> pa.RecordBatch:
            nonlocal opened, name
            if file != name:
                system, inner = _opened(file)
                opened, name = system.open_input_file(inner), file
            low = spans[0][0]
            raw = opened.read_at(spans[-1][0] + spans[-1][1] - low, low)
            rows = []
            for offset, length in spans:
                h, payload, _, _ = next(parse(raw[offset - low : offset - low + length]))
                rows.append({"page_id": _id(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "record_type": h["WARC-Type"], "refers_to": _id(h.get("WARC-Refers-To")),
                             "digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": payload, "file": file, "offset": offset, "length": length})
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            spans, last = [], None
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if spans and (file != last or offset != spans[-1][0] + spans[-1][1] or offset + length - spans[0][0] > READ_BYTES):
                    yield read(last, spans)
                    spans = []
                spans.append((offset, length))
                last = file
            if spans:
                yield read(last, spans)

    return placed.mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, from archives written, indexed and read back by URL.

    What a revisit leaves out is looked up in the response that it refers to; digests
    are taken of the payloads as read.
    """
    spark = pages.sparkSession
    path, index = fresh_path(spark, "archives"), fresh_path(spark, "index")
    write(pages, path)
    build_index(captures(spark, path), index)
    found = CaptureIndex(spark, index).captures(pages)
    back = stage(fetch(found).select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("own")), "records")
    responses = back.where("record_type = 'response'")
    # rows that share a page_id may have several payloads: the declared digest tells which one is meant
    meant = responses.where(F.col("size") >= REVISIT_BYTES).select(F.col("page_id").alias("refers_to"), F.col("own").alias("digest"), F.col("own").alias("payload_digest"), F.col("size").alias("payload_bytes")).distinct()
    revisits = back.where("record_type = 'revisit'").join(meant, ["refers_to", "digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select("page_id", F.col("size").alias("payload_bytes"), F.col("own").alias("payload_digest"), "record_type", "refers_to").unionByName(revisits.select(*columns))
