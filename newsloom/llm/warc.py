"""WARC archives whose records are compressed one by one with a dictionary of their own.

Pages with equal payloads of at least least_bytes become one response and revisits of it. Each task
fills archives of bounded size: it trains a Zstandard dictionary on pieces of the archive's records (where they are too few or too
much alike to train on, a piece of them is the dictionary as it is),
writes it in a leading skippable frame, and compresses every record as a frame of its own, so that
one record can be read without those before it. Archives are files in the shared folder, written
under a name of the attempt and renamed when whole, so that a lost executor leaves no half archive;
the driver gets a line for each archive only, and only archives so named are read back.

Cases: a null html is an empty payload; empty payloads are equal but shorter than least_bytes, so each is a
response; a null url is written as an empty target; null page_ids are written and read as such;
repeated rows with one page_id: one of them is the response; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import bounded_batches
from newsloom.session import materialize, scratch_path

#: The magic number of the skippable frame that holds a dictionary, that of any frame, that of a dictionary.
DICT_FRAME, FRAME, DICT = 0x184D2A5D, 0xFD2FB528, 0xEC30A437

READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def decide(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """pages (page_id, url, html) with digest, bytes, record_type and refers_to; html is null for revisits.

    The largest page_id of equal payloads is found from digests alone, combined before the shuffle. Nothing but the join follows
    the shuffle of the pages, so Spark can split the partition of a payload that very many pages have.
    """
    payload = F.to_binary(F.coalesce("html", F.lit("")), F.lit("utf-8"))
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha2(payload, 256).alias("sha"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    each = keyed.where(F.col("bytes") >= least_bytes).groupBy("sha", "page_id").agg(F.count("*").alias("times"))
    last = each.groupBy("sha").agg(F.max(F.struct(F.col("page_id").isNotNull(), "page_id", "times")).alias("last"), F.sum("times").alias("n")).where("n > 1")
    last = materialize(last.select("sha", F.col("last.page_id").alias("last"), F.col("last.times").alias("times")).where("last is not null"), "last")
    rows = keyed.join(last, "sha", "left")
    is_last = F.coalesce(F.col("page_id") == F.col("last"), F.lit(False))
    revisit = F.col("last").isNotNull() & ~is_last
    kind = lambda again: [F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("last")).alias("refers_to")]
    common = ["page_id", "url", "digest", "bytes"]
    decided = rows.select(*common, F.when(~revisit, F.col("html")).alias("html"), *kind(revisit), (is_last & (F.col("times") > 1)).alias("tied"), "sha", "last")
    if last.where("times > 1").isEmpty():
        return decided.drop("tied", "sha", "last")
    # Rows repeated with the last page_id: of those with the least url one is the response. They are counted, and only that one keeps its html.
    tied = decided.where("tied").groupBy("sha", "last", *common).agg(F.count("*").alias("times"), F.first("html").alias("html"))
    tied = materialize(tied, "tied")
    least = tied.groupBy(F.col("sha").alias("of")).agg(F.min(F.struct(F.col("url").isNotNull().alias("some"), "url")).alias("least"))
    tied = tied.join(least, F.col("sha") == F.col("of")).withColumn("first", F.col("url").eqNullSafe(F.col("least.url")))
    tied = tied.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    again = ~(F.col("first") & (F.col("nth") == 1))
    return decided.where("not tied").drop("tied", "sha", "last").unionByName(tied.select(*common, F.when(~again, F.col("html")).alias("html"), *kind(again)))


def record(page_id, url, html: str | None, digest: str, kind: str, refers_to, size: int | None = None) -> bytes:
    """A WARC record; its payload is the html in UTF-8, behind an HTTP header. A revisit has no payload but names its size."""
    payload = (html or "").encode()
    size = len(payload) if size is None else size
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
    ]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        block += payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes], dict_bytes: int, sample_bytes: int, piece: int = 16384) -> zstandard.ZstdCompressionDict:
    """A dictionary for records: trained on pieces of records evenly picked from all, up to sample_bytes, or else raw content."""
    step = max(1, -(-sum(map(len, records)) // sample_bytes))
    samples = [r[at : at + piece] for r in records[::step] for at in range(0, len(r), piece)]
    size = min(dict_bytes, max(1024, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8)
    except zstandard.ZstdError:  # too few samples, or too short or too alike ones
        content = b"".join(samples[: 1 + size // piece])[:size]
        return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], dict_bytes: int = 65536, sample_bytes: int = 8 << 20) -> bytes:
    """The bytes of an archive: a skippable frame with the dictionary, then a frame for each record."""
    if not records:
        return b""
    shared = dictionary(records, dict_bytes, sample_bytes)
    body = zstandard.ZstdCompressor(level=9).compress(shared.as_bytes())
    press = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True)
    return b"".join([struct.pack("<II", DICT_FRAME, len(body)), body, *map(press.compress, records)])


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    at, trained = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        body = data[8 : 8 + size]
        if struct.unpack_from("<I", body)[0] == FRAME:  # the dictionary may be compressed itself
            body = zstandard.ZstdDecompressor().decompress(body)
        kind = zstandard.DICT_TYPE_FULLDICT if struct.unpack_from("<I", body.ljust(4))[0] == DICT else zstandard.DICT_TYPE_RAWCONTENT
        trained, at = zstandard.ZstdCompressionDict(body, dict_type=kind), 8 + size
    open_ = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    rest = memoryview(data)[at:]
    while len(rest):
        one = open_.decompressobj()
        whole = one.decompress(rest)
        rest = rest[len(rest) - len(one.unused_data) :]
        head, _, tail = whole.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, tail[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 32 << 20) -> DataFrame:
    """Write decided pages to archives in folder; a row (path, records, bytes) for each archive."""
    bounded_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)

        def put(records: list[bytes]) -> pa.RecordBatch:
            name, data = f"{root}/{uuid.uuid4().hex}", archive(records)
            with store.open_output_stream(f"{name}.part", compression=None) as f:
                f.write(data)
            store.move(f"{name}.part", f"{name}.warc.zst")
            return pa.RecordBatch.from_pydict({"path": [f"{name}.warc.zst"], "records": [len(records)], "bytes": [len(data)]})

        records, size = [], 0
        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "html", "digest", "record_type", "refers_to", "bytes")), strict=True):
                records.append(record(*row))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield put(records)
                    records, size = [], 0
        if records:
            yield put(records)

    return pages.mapInArrow(write, "path string, records long, bytes long")


def read_archives(written: DataFrame, folder: str) -> DataFrame:
    """READ for each record of the archives of written (path)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        number = lambda s: int(s) if s else None
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for path in b.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
                rows = []
                for h, block in read_archive(data):
                    size, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: the payload of {h['WARC-Record-ID']} is damaged")
                    rows.append((number(h["WARC-Record-ID"][10:-1]), h["WARC-Target-URI"], size, digest, h["WARC-Type"], number(h.get("WARC-Refers-To", "<urn:page:>")[10:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    # A task for each archive: ranges of as many names as there are, each of which the sample sees.
    return written.select("path").repartitionByRange(max(1, written.count()), "path").mapInArrow(read, READ)


def archive_pages(pages: DataFrame, least_bytes: int = 1000, folder: str | None = None) -> DataFrame:
    """Write pages to archives and read them back: READ for each page."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    return read_archives(materialize(write_archives(decide(pages, least_bytes), folder), "archives"), folder)
