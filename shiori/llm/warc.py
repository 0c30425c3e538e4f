"""WARC archives: one gzip member per record, read back by byte ranges.

:func:`write_warc` writes a record per row into archives in the shared folder;
:func:`read_warc` cuts every archive into byte ranges.  A task scans its range
for the gzip magic, accepts a candidate only if it decodes to a WARC record, then
walks member by member, and owns exactly the records that start in its range (it
reads past its end to finish the last one).

A record's payload may hold a stored member, which decodes as well.  So ranges are
settled before they are read: each tells where its first member starts and its last
one ends, and a range that does not begin where those before it end is walked again
from there.  An archive of one range needs none of that.

Lost executors: a task writes under a name that holds a fresh id and reports it;
only reported archives are read, so retries and speculative copies leave no
records behind.

Edge cases: a null payload is the empty payload; a null page_id is lower than
any other and is read back as null; a null url is written as ``urn:none`` and
read back as null.  Repeated rows with the largest page_id of their payload are
all responses.  An empty table gives no archives and no rows.  Columns other
than the three named are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shiori.llm.common import new_path, release, scratch, written

#: Fixed values of the formats.
GZIP_MAGIC = b"\x1f\x8b\x08"
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A record's date; fixed, so that equal rows give equal archives.
DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 1 << 20
#: Decompressed bytes within which a candidate member must show its WARC version line.
PROBE_BYTES = 64


#: Schemes of Hadoop's file systems that pyarrow.fs knows by other names.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def opened(uri: str) -> tuple:
    """The file system of a URI, and the path in it."""
    scheme, colon, rest = uri.partition(":")
    if scheme == "file" and not rest.startswith("//"):
        rest = "//" + rest
    return pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    digest = base32_sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "urn:none" if url is None else "".join(url.split())),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to)), ("X-Payload-Length", str(len(payload)))]
    raw = WARC_VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(raw: bytes) -> dict:
    """Headers and payload of a decoded member."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return {"fields": fields, "payload": block.partition(b"\r\n\r\n")[2]}


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", smallest: int = 0) -> DataFrame:
    """Writes the archives under ``path`` (a URI of a store that pyarrow.fs opens, by Hadoop's name or its own); returns (uri, n_bytes, n_records).

    Of records with equal payloads of at least ``smallest`` bytes, those with the
    largest id are responses and the others revisit them.  Duplicates are found
    on digests alone; only digests that occur twice go to the join, and Spark
    broadcasts that written table only if it is below its own threshold.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    big = rows.filter(F.octet_length("payload") >= smallest)
    twice = big.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).filter("n > 1")
    twice = written(twice.select("digest", "top", F.lit(True).alias("dup")), "warc-twice")
    size_ok = F.octet_length("payload") >= smallest
    rows = rows.join(twice, "digest", "left").select(
        "id", "url", "payload",
        (F.coalesce("dup", F.lit(False)) & size_ok & ~F.col("id").eqNullSafe(F.col("top"))).alias("revisit"),
        F.col("top").alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, size, uri = None, 0, 0, ""
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    uri = f"{path}/{uuid.uuid4().hex}.warc.gz"
                    fs, at = opened(uri)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)  # else the name would ask for one more gzip
                member = build_record(*(batch.column(c)[i].as_py() for c in range(5)))
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "n_bytes": [size], "n_records": [n]})

    out = written(rows.mapInArrow(write, "uri string, n_bytes long, n_records long"), "warc-archives")
    release(twice)
    return out


def members(source, start: int, end: int) -> Iterator[bytes]:
    """Decoded members of an open archive that start in [start, end)."""
    return (raw for raw, _, _ in located(source, start, end))


def located(source, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """:func:`members`, each with where it starts and ends.

    One chunk of the archive is held beside the member that is being decoded; a
    candidate that turns out false late is left by reading on from its second byte.
    """
    at, known = start, False
    window, base = b"", start

    def reach(place: int) -> bool:
        """Makes the window hold the byte at ``place``."""
        nonlocal window, base
        if not base <= place < base + len(window):
            window, base = source.read_at(READ_BYTES, place), place
        return len(window) > 0

    while at < end:
        if not reach(at):
            return
        if not known:
            found = window.find(GZIP_MAGIC, at - base)
            if found < 0:
                # The magic may lie across the window's end.
                after = base + len(window) - len(GZIP_MAGIC) + 1
                at = max(at + 1, after)
                if len(window) - (at - base) < len(GZIP_MAGIC):
                    window, base = source.read_at(READ_BYTES, at), at
                    if len(window) < len(GZIP_MAGIC):
                        return
                continue
            at = base + found
            if at >= end:
                return
        decoder, held, first, bad, place = zlib.decompressobj(31), [], b"", False, at
        while not decoder.eof:
            if not reach(place):
                bad = True
                break
            chunk = window[place - base :]
            try:
                held.append(decoder.decompress(chunk))
            except zlib.error:
                bad = True
                break
            place += len(chunk)
            if len(first) < 5:
                first = (first + held[-1])[:PROBE_BYTES]
                if len(first) >= 5 and not first.startswith(b"WARC/"):
                    bad = True
                    break
        if bad or not first.startswith(b"WARC/"):
            at, known = at + 1, False
            continue
        stop = place - len(decoder.unused_data)
        yield b"".join(held), at, stop
        at, known = stop, False
        if reach(at):
            head = window[at - base : at - base + 3]
            known = (head if len(head) == 3 else source.read_at(3, at)) == GZIP_MAGIC


def settled(ranges: DataFrame) -> DataFrame:
    """``ranges`` (uri, start, end) with ``begin``: where the first member that belongs to each starts; a range without one is left out.

    Members do not overlap, so a range goes on where the ranges before it have ended;
    what begins elsewhere has taken a payload for a member (or passed over bytes that
    are no member, and does so again).  A round walks the ranges that are wrong; each
    range is one row of numbers in a written table.
    """
    schema = "uri string, start long, end long, begin long, first long, last long"
    tasks = max(1, min(ranges.count(), 4 * int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = [], []
            for r in batch.to_pylist():
                found = None, None
                if r["begin"] < r["end"]:
                    fs, at = opened(r["uri"])
                    with fs.open_input_file(at) as source:
                        for _, a, b in located(source, r["begin"], r["end"]):
                            found = a if found[0] is None else found[0], b
                first.append(found[0])
                last.append(found[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=[c.split()[0] for c in schema.split(", ")])

    def walked(rows: DataFrame) -> DataFrame:
        return rows.select("uri", "start", "end", F.col("begin").cast("long").alias("begin")).repartition(tasks).mapInArrow(survey, schema)

    with scratch() as keep:
        found = written(walked(ranges.withColumn("begin", F.col("start"))), "warc-ranges")
        while True:
            before = Window.partitionBy("uri").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
            told = found.withColumn("carry", F.max("last").over(before))
            right = F.col("carry").isNull() | F.col("begin").eqNullSafe(F.col("carry")) | F.col("first").eqNullSafe(F.col("carry")) | (F.col("first").isNull() & (F.col("carry") >= F.col("end")))
            wrong = written(told.filter(~right).select("uri", "start", "end", F.col("carry").alias("begin")), "warc-wrong")
            if not wrong.head(1):
                return keep(found).filter("first is not null").select("uri", "end", F.col("first").alias("begin"))
            rest = found.join(wrong.select("uri", "start"), ["uri", "start"], "left_anti").select(*found.columns)
            found = written(rest.unionByName(walked(wrong)), "warc-ranges")


def read_warc(archives: DataFrame, *, split_bytes: int = 8 << 20) -> DataFrame:
    """Every record of the archives (columns ``uri`` and ``n_bytes``), split into byte ranges.

    Returns page_id, url, record_type, refers_to, payload (null for revisits),
    payload_bytes and payload_digest (of the payload read, or as a revisit states).
    """
    ranges = archives.filter("n_bytes > 0").select("uri", "n_bytes", F.explode(F.sequence(F.lit(0), F.col("n_bytes") - 1, F.lit(split_bytes))).alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + split_bytes).withColumn("begin", F.col("start"))
    several = ranges.filter(F.col("n_bytes") > split_bytes)
    count = ranges.count()
    ranges = ranges.filter(F.col("n_bytes") <= split_bytes).select("uri", "end", "begin")
    if several.head(1):
        ranges = ranges.unionByName(settled(several.select("uri", "start", "end")))
    spark = archives.sparkSession
    tasks = max(1, min(count, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    schema = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                fs, at = opened(r["uri"])
                with fs.open_input_file(at) as source:
                    for raw in members(source, r["begin"], r["end"]):
                        x = parse_record(raw)
                        f, payload = x["fields"], x["payload"]
                        revisit = f["warc-type"] == "revisit"
                        url, page, ref = f.get("warc-target-uri"), f.get("x-page-id"), f.get("x-refers-to-page-id")
                        rows.append((
                            int(page) if page else None, None if url == "urn:none" else url, f["warc-type"],
                            int(ref) if ref and ref != "None" else None, None if revisit else payload,
                            int(f["x-payload-length"]) if revisit else len(payload),
                            f["warc-payload-digest"].partition(":")[2] if revisit else base32_sha1(payload),
                        ))
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 4096:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    return ranges.repartition(tasks).mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back."""
    return read_warc(write_warc(pages, new_path(pages.sparkSession, "warc")))
