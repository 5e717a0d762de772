"""WARC archives: writing pages as segmented, chunked records, and reassembling them.

A page is a response record, or a revisit if a page with a smaller page_id has the same payload (of LEAST_PAYLOAD bytes
at least). A response's block is an HTTP message in chunked transfer coding. Blocks over SEGMENT bytes are cut: the
first segment is the response record itself, the others are continuation records that name the record they continue
(WARC-Segment-Origin-ID) and their number; the last has the total length. Continuations go to archives of their own.

The reader emits whole records at once. Segments are grouped by their origin's identifier in Spark, ordered by number,
checked for gaps and against the total length, joined, and decoded from the chunked framing. A group is one record's
segments, so its size is a page's size.

Defined results: a null html is empty; rows with the same payload and the same smallest page_id are all responses; a
null page_id comes back as null and is a response only if no row with its payload has an id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

SEGMENT = 16 << 10
CHUNK = 4 << 10
LEAST_PAYLOAD = 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Payload of a body in chunked framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("the chunked body ends early")
        size = int(body[at:line].split(b";")[0].strip() or b"x", 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it should")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response block, with its transfer framing taken off."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("the HTTP head has no end")
    fields = dict(line.split(b":", 1) for line in head.lower().split(b"\r\n")[1:] if b":" in line)
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    text = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode()
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(text + block + b"\r\n\r\n") + packer.flush()


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an open archive, gzipped or plain."""
    reader = io.BufferedReader(stream) if not hasattr(stream, "peek") else stream
    if reader.peek(2)[:2] == b"\x1f\x8b":
        reader = io.BufferedReader(gzip.GzipFile(fileobj=reader))
    while line := reader.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := reader.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        block = reader.read(int(size)) if size.isdigit() else b""
        if not size.isdigit() or len(block) < int(size):
            raise ValueError("the archive ends inside a record")
        yield fields, block


def segments(head: list[tuple[str, str]], kind: str, identity: str, block: bytes, size: int, new_id) -> Iterator[bytes]:
    """The records of one block: one, or a first segment and its continuations."""
    first = [("WARC-Type", kind), ("WARC-Record-ID", identity), *head]
    if len(block) <= size:
        yield record(first, block)
        return
    parts = [block[i : i + size] for i in range(0, len(block), size)]
    yield record([*first, ("WARC-Segment-Number", "1")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", new_id()), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", identity), ("WARC-Segment-Number", str(n)), *last], part)


def write_archives(pages: DataFrame, folder: str, segment: int = SEGMENT) -> DataFrame:
    """Write pages (page_id, url, html) as archives below folder; returns the manifest (path)."""
    run = uuid.uuid4()
    key = F.col("page_id").cast("long")
    rows = pages.select(key.alias("id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    shared = rows.where(F.octet_length("html") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # Digests of several pages only, and written first: a bounded number is broadcast, and no payload is moved for it.
    shared = work.small(work.written(shared, f"{folder}-shared"))
    rows = rows.join(shared, "digest", "left")
    rows = rows.select(F.coalesce("id", F.lit(0)).alias("k"), F.col("id").isNull().alias("m"), "url", "html", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))
    rows = rows.select("k", "m", "url", "html", "digest", F.coalesce("refers", F.lit(0)).alias("r"), F.col("refers").isNotNull().alias("again"))

    def write(batches):
        import pandas as pd

        where = f"{TaskContext.get().partitionId():07d}-{TaskContext.get().taskAttemptId()}"
        count = 0

        def new_id() -> str:
            nonlocal count
            count += 1
            return f"<urn:uuid:{uuid.uuid5(run, f'{where}/{count}')}>"

        out: dict[str, object] = {}

        def put(kind: str, data: bytes) -> None:
            if kind not in out:
                name = f"{folder}/{run.hex[:8]}-{where}-{kind}.warc.gz"
                out[kind] = (name, work.open_new(name))
            out[kind][1].write(data)

        for batch in batches:
            for k, m, url, html, digest, r, again in batch.itertuples(index=False, name=None):
                head = [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if url is not None:
                    head.append(("WARC-Target-URI", "".join(c if c > " " else "%20" for c in url)))
                if not m:
                    head.append(("X-Page-ID", str(k)))
                if again:
                    head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(r))]
                    put("main", record([("WARC-Type", "revisit"), ("WARC-Record-ID", new_id()), *head], HTTP_HEAD))
                    continue
                block = HTTP_HEAD + chunked(html.encode("utf-8", "surrogatepass"))
                for n, data in enumerate(segments(head, "response", new_id(), block, segment, new_id)):
                    put("rest" if n else "main", data)
        for name, stream in out.values():
            stream.close()
            yield pd.DataFrame({"path": [name]})

    return rows.mapInPandas(work.tidy(write), "path string")


SEGMENT_ROWS = "origin string, number int, total long, whole boolean, kind string, page_id string, refers_to string, digest string, block binary, n long, sha string"


def _segments_of(batches):
    import pandas as pd

    names = [x.split()[0] for x in SEGMENT_ROWS.split(", ")]
    for batch in batches:
        for path in batch["path"]:
            rows, held = [], 0
            with work.open_read(path) as stream:
                for fields, block in records(stream):
                    kind, number = fields["warc-type"], int(fields.get("warc-segment-number", 1))
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    whole = kind == "revisit" or kind == "response" and "warc-segment-number" not in fields
                    payload = payload_of(block) if whole and kind == "response" else None
                    total = fields.get("warc-segment-total-length")
                    rows.append((fields.get("warc-segment-origin-id", fields["warc-record-id"]), number, int(total) if total else None, whole, kind, fields.get("x-page-id"), fields.get("x-refers-to-page-id"), fields.get("warc-payload-digest", "").removeprefix("sha256:"), None if whole else block, None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest()))
                    held += 0 if whole else len(block)
                    if len(rows) >= 1000 or held > 4 << 20:
                        yield pd.DataFrame(rows, columns=names).astype({"total": "Int64", "n": "Int64"})
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"total": "Int64", "n": "Int64"})


def reassembled(parts: list[tuple[int, bytes]], total: int | None) -> bytes:
    """The block of a segmented record: numbers must run from 1 without gaps, lengths must add up to the total."""
    parts = sorted(parts, key=lambda p: p[0])
    if [n for n, _ in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("segments are missing or repeated")
    block = b"".join(b for _, b in parts)
    if total is None or total != len(block):
        raise ValueError(f"segments have {len(block)} bytes, the record {total}")
    return block


def _reassemble(batches):
    for batch in batches:
        n, sha, error = [], [], []
        for parts, total in zip(batch["parts"], batch["total"], strict=True):
            try:
                payload = payload_of(reassembled([(int(p["number"]), p["block"]) for p in parts], None if total != total or total is None else int(total)))
                n.append(len(payload))
                sha.append(hashlib.sha256(payload).hexdigest())
                error.append(None)
            except ValueError as e:
                n.append(-1)
                sha.append(None)
                error.append(str(e))
        yield batch[["page_id"]].assign(n=n, sha=sha, error=error)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and error of the pages in a manifest's archives."""
    files = max(1, manifest.count())
    rows = work.written(manifest.repartition(files).mapInPandas(work.tidy(_segments_of), SEGMENT_ROWS), f"{folder}/segments")
    whole = rows.where("whole and kind = 'response'").select("page_id", "n", "sha", F.lit(None).cast("string").alias("error"))
    cut = rows.where("not whole").groupBy("origin").agg(F.max("page_id").alias("page_id"), F.max("total").alias("total"), F.collect_list(F.struct("number", "block")).alias("parts"))
    joined = cut.select("page_id", F.coalesce("total", F.lit(-1)).alias("total"), "parts").mapInPandas(work.tidy(_reassemble), "page_id string, n long, sha string, error string")
    responses = whole.unionByName(joined)
    first = responses.where("sha is not null").groupBy("page_id", "sha").agg(F.max("n").alias("n"))
    revisits = rows.where("kind = 'revisit'").select("page_id", F.col("refers_to").alias("to"), F.col("digest").alias("named"))
    again = revisits.join(first.select(F.col("page_id").alias("to"), F.col("sha").alias("named"), "n"), ["to", "named"], "left")
    out = responses.select("page_id", F.when(F.col("n") >= 0, F.col("n")).alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), "error")
    out = out.unionByName(again.select("page_id", F.col("n").alias("payload_bytes"), F.when(F.col("n").isNotNull(), F.col("named")).alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("to").alias("refers_to"), F.when(F.col("n").isNull(), F.lit("the record it revisits is not there")).alias("error")))
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages to archives and give what is read back from them."""
    folder = work.work_folder(spark, "warc")
    manifest = work.written(write_archives(pages, f"{folder}/archives"), f"{folder}/manifest")
    return read_archives(manifest, folder).drop("error")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_PAYLOAD} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_PAYLOAD} AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
