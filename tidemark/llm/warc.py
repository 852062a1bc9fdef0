"""Writing and reading WARC archives by way of an index.

Writing gives an index first: a row per record with file, offset, length, URL and digest. Reading
takes the index rows wanted, sorts them by file and offset, joins neighbours into byte ranges and
reads each range once. Every record is a gzip member of its own, so a range can be read alone.

Records are HTTP responses. A page whose payload equals that of another page with a larger page_id
is written as a revisit: its block has the HTTP headers, Content-Length included, and no payload.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.scratch import new_folder, open_folder, small_batches, written

INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
BATCH = 256  # pages a task holds at a time
DATE = "2024-01-01T00:00:00Z"  # pages carry no time


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record of a page; ``refers_to`` is the page_id of the response for a revisit, else None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "" if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record; names in lower case."""

    def fields(head: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _digest(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = 1 << 28) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) into ``folder``; the index, as a table written there too.

    The payload is html in UTF-8, empty for null. Of records with equal payloads of ``least_bytes``
    or more the one with the largest page_id is the response and the others revisit it; smaller
    payloads are always responses. Rows that repeat that largest page_id are all responses. A null
    page_id sorts below all others. A task holds ``BATCH`` pages at a time, however long. An empty table gives an
    empty index and no file.
    """

    def run(batches):
        import zlib

        import pyarrow as pa

        files, path = open_folder(folder)
        files.create_dir(path, recursive=True)
        attempt, count, out, at, name = uuid.uuid4().hex[:12], 0, None, 0, ""
        for batch in batches:
            rows = []
            for page_id, url, html, target in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "target")), strict=True):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, count, at = f"pages-{attempt}-{count:05d}.warc.gz", count + 1, 0
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                payload = html.encode("utf-8")
                digest = _digest(payload)
                gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = gz.compress(record(page_id, url, payload, digest, target)) + gz.flush()
                out.write(packed)
                rows.append((name, at, len(packed), page_id, url, digest, "response" if target is None else "revisit"))
                at += len(packed)
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = given.withColumn("_sha", F.sha1(F.col("html").cast("binary"))).withColumn("_big", F.octet_length("html") >= least_bytes)
    equal = keyed.where("_big").groupBy("_sha").agg(F.max("page_id").alias("_top"), F.count("*").alias("_n")).where("_n > 1").select("_sha", "_top")
    # only pages of repeated payloads are compared; the rest are responses whatever they hold
    joined = keyed.join(equal, "_sha", "left")
    target = F.when(F.col("_big") & F.col("_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top")), F.col("_top"))
    rows = joined.select("page_id", "url", "html", target.alias("target"))
    parts = max(4, -(-pages.count() // 500_000))  # files of some 50 MB, not one from each task
    with small_batches(pages.sparkSession, BATCH):
        return written(rows.mapInArrow(run, INDEX).repartition(parts), folder, "index")


def byte_ranges(index: DataFrame, most_gap: int = 1 << 16, most_bytes: int = 1 << 23) -> DataFrame:
    """(file, start, stop, records) from index rows: neighbours in a file joined across gaps of up to ``most_gap`` bytes.

    A range ends where the next stretch of ``most_bytes`` of its file begins, so ranges, and what a
    task holds, are bounded.
    """
    stretch = F.floor(F.col("offset") / most_bytes)
    w = Window.partitionBy("file", stretch).orderBy("offset")
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(w)
    cut = index.withColumn("_stretch", stretch).withColumn("_new", (F.coalesce(gap, F.lit(0)) > most_gap).cast("int"))
    cut = cut.withColumn("_range", F.sum("_new").over(w))
    at = F.sort_array(F.collect_list(F.struct("offset", "length")))
    return cut.groupBy("file", "_stretch", "_range").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), at.alias("records")).select("file", "start", "stop", "records")


READ = "file string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_warc(index: DataFrame, folder: str, with_payload: bool = True, most_gap: int = 1 << 16, most_bytes: int = 1 << 23) -> DataFrame:
    """The records of the given index rows, read by coalesced byte ranges.

    payload_bytes and payload_digest are those of the full payload: of a response they are taken
    from the payload itself and checked against the headers, of a revisit from its headers. Each
    task reads some ``most_bytes`` of archives.
    """

    def run(batches):
        import zlib

        import pyarrow as pa

        files, path = open_folder(folder)
        name, file = None, None
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        page = lambda urn: None if (x := urn[len("<urn:page:") : -1]) == "None" else int(x)
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, file = row["file"], files.open_input_file(f"{path}/{row['file']}")
                raw, out = file.read_at(row["stop"] - row["start"], row["start"]), []
                for r in row["records"]:
                    skip = r["offset"] - row["start"]
                    warc, http, payload = parse(zlib.decompress(raw[skip : skip + r["length"]], 31))
                    digest, n = warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                    kind = warc["warc-type"]
                    if kind == "response" and (len(payload) != n or _digest(payload) != digest):
                        raise ValueError(f"{name} at {r['offset']}: payload and headers differ")
                    refers = page(warc["warc-refers-to"]) if kind == "revisit" else None
                    out.append((name, r["offset"], page(warc["warc-record-id"]), warc["warc-target-uri"], kind, n, digest, refers, payload if with_payload else None))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    ranges = byte_ranges(index, most_gap, most_bytes)
    parts = -(-(index.agg(F.sum("length")).first()[0] or 1) // most_bytes)  # by number: the index is small, the archives are not
    return ranges.repartition(parts, "file", F.floor(F.col("start") / most_bytes)).sortWithinPartitions("file", "start").mapInArrow(run, READ)


def archive_digests(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives and read every record back: page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset."""
    folder = new_folder(pages.sparkSession, "warc")
    index = write_warc(pages, folder)
    return read_warc(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset")
