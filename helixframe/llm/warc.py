"""Deterministic sharded WARC archives: writer and reader.

Records are sorted by page_id. Shards are contiguous ranges of page_id with about
equal payload bytes: a histogram over id ranges, refined where a range holds too
much, gives bounds that depend on the rows alone and not on their layout. Within a
shard a file is closed once its compressed size reaches a limit. Every record is a
gzip member of its own; ids, dates, lengths and digests are made anew from the row,
so the same rows give the same bytes, and a task that runs twice writes the same
files. A file is written under a temporary name that is unique to the attempt and then
moved to its own; the manifest lists what belongs to the archive, and readers read
only that.

Equal payloads of at least ``least`` bytes are stored once, with the largest page_id;
the others become revisit records that refer to it.

Null payloads are empty ones, and null URLs are replaced by ``urn:page:`` and the
id. Repeated rows give a record each; with equal ids and payloads one is the
response and the rest refer to that id. Rows without page_id are refused. An empty
table gives a manifest without files. A very long payload is one record, and the file that it ends in may
exceed the limit by it. Extra columns are ignored. Texts that hold
control characters in the URL get them percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MANIFEST = "shard int, number int, path string, records long, bytes long, sha1 string, first_id long, last_id long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def uri(url: str | None, page_id: int) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else f"urn:page:{page_id}"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, nth: int = 0) -> bytes:
    """One record as a gzip member."""
    digest = hashlib.sha1(payload).digest()
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Target-URI: {uri(url, page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Record-ID: {record_id(page_id, f'{digest.hex()}:{kind}:{nth}')}",
        f"WARC-Payload-Digest: sha1:{base32(digest)}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, f'{digest.hex()}:response:0')}", f"X-Refers-To-Page-ID: {refers_to}"]
    if url is None:
        lines.append("X-No-URL: 1")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    unpack, out = zlib.decompressobj(31), []
    while chunk := stream.read(size):
        while chunk:
            out.append(unpack.decompress(chunk))
            chunk = b""
            if unpack.eof:
                chunk = unpack.unused_data
                yield b"".join(out)
                unpack, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the file ends within a record")


def parse(raw: bytes) -> tuple[int, str | None, int, str, str, int | None, bytes]:
    """A row of RECORDS; raises where length or digest differ from the header's."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if rest[len(block) :] != b"\r\n\r\n" or "sha1:" + base32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).digest() != digest or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    refers = fields.get("X-Refers-To-Page-ID")
    url = None if "X-No-URL" in fields else fields["WARC-Target-URI"]
    return int(fields["X-Page-ID"]), url, int(fields["X-Payload-Length"]), digest.hex(), kind, None if refers is None else int(refers), payload


def placed(held):
    """The range that an id lies in, -1 for none, and its cell there. held: broadcast starts, ends and cell sizes of ascending ranges."""

    @F.pandas_udf("span long, cell long")
    def place(page_id: pd.Series) -> pd.DataFrame:
        lows, highs, steps = held.value
        x = page_id.to_numpy(np.int64)
        at = np.searchsorted(lows, x, "right") - 1
        cell = (x.astype(np.uint64) - lows[at].astype(np.uint64)) // steps[at].astype(np.uint64)
        return pd.DataFrame({"span": np.where((at >= 0) & (x <= highs[at]), at, -1), "cell": cell.astype(np.int64)})

    return place


def shard_starts(sizes: DataFrame, shard_bytes: int, most_shards: int, most_cells: int = 1 << 16) -> np.ndarray:
    """The first page_id of each shard. sizes: page_id, size.

    Ranges of ids that hold too much are cut into cells, all of them in one job, until none does; about most_cells
    come to the driver each time.
    """
    low, high, total = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("size")).first()
    if low is None:
        return np.zeros(0, np.int64)
    target = max(shard_bytes, -(-int(total) // most_shards))
    spans, cells = [(int(low), int(high))], []  # both ends within
    while spans:  # at most total / target of them
        fanout = max(4, most_cells // len(spans))
        steps = [max(1, -(-(hi - lo + 1) // fanout)) for lo, hi in spans]
        place = placed(sizes.sparkSession.sparkContext.broadcast((*(np.array(x, np.int64) for x in zip(*spans, strict=True)), np.array(steps, np.int64))))
        found = sizes.withColumn("at", place("page_id")).filter("at.span >= 0").groupBy("at.span", "at.cell").agg(F.sum("size").alias("size"), F.min("page_id").alias("first")).collect()
        wide = []
        for span, cell, size, first in found:
            lo, step = spans[span][0] + cell * steps[span], steps[span]
            if size > target and step > 1:
                wide.append((lo, min(spans[span][1], lo + step - 1)))
            else:
                cells.append((first, int(size)))
        spans = sorted(wide)
    starts, filled = [], target
    for first, size in sorted(cells):
        if filled + size > target:
            starts.append(first)
            filled = 0
        filled += size
    return np.array(starts, np.int64)


def write(pages: DataFrame, folder: str, least: int = 1000, shard_bytes: int = 64 << 20, file_bytes: int = 16 << 20, most_shards: int = 50_000) -> DataFrame:
    """Write the archive below folder (any URI that pyarrow opens); returns its manifest."""
    spark = pages.sparkSession
    rows = common.plain(pages, "page_id", "url", "html")
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    facts = rows.select(F.coalesce("page_id", F.raise_error(F.concat(F.lit("a page has no page_id: "), F.coalesce("url", F.lit("")))).cast("long")).alias("page_id"), F.sha1(data).alias("digest"), F.octet_length(data).cast("long").alias("size"))
    facts = common.materialise(facts, "warc-facts")
    firsts = facts.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    repeats = facts.join(common.looked_up(firsts, "warc-firsts"), ["digest", "size"])
    nth = F.row_number().over(Window.partitionBy("digest", "size", "page_id").orderBy("page_id"))
    # rows with the response's own id and payload: one of them is the response
    same = repeats.filter(F.col("page_id") == F.col("refers_to")).withColumn("nth", nth).filter("nth > 1").drop("nth")
    marks = repeats.filter(F.col("page_id") != F.col("refers_to")).unionByName(same).groupBy("page_id", "digest").agg(F.max("refers_to").alias("refers_to"), F.count(F.lit(1)).alias("n"))

    held = spark.sparkContext.broadcast(shard_starts(facts.select("page_id", (F.col("size") + 512).alias("size")), shard_bytes, most_shards))

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, page_id.to_numpy(np.int64), "right") - 1, dtype="int32")

    nothing = {"url": F.lit(None).cast("string"), "html": F.lit(None).cast("string")}
    own = rows.withColumns({"digest": F.lit(None).cast("string"), "refers_to": F.lit(None).cast("long"), "n": F.lit(None).cast("long"), "kind": F.lit(1)})
    both = marks.withColumns(nothing | {"kind": F.lit(0)}).unionByName(own).withColumn("shard", shard_of("page_id"))

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        made: list[tuple] = []
        out = None
        shard, number, page, left, times = None, 0, None, {}, {}

        def close() -> None:
            nonlocal out, number
            if out:
                out.close()
                name = f"{base}/part-{shard:05d}-{number:05d}.warc.gz"
                store.move(f"{base}/_temporary-{attempt}", name)
                made.append((shard, number, f"part-{shard:05d}-{number:05d}.warc.gz", count, size, sha1.hexdigest(), first, last))
                out, number = None, number + 1

        for b in batches:
            for r in b.itertuples(index=False):
                page_id = int(r.page_id)
                if r.shard != shard:
                    close()
                    shard, number = int(r.shard), 0
                if page_id != page:
                    page, left, times = page_id, {}, {}
                if r.kind == 0:
                    left[r.digest] = [int(r.refers_to), int(r.n)]
                    continue
                payload = b"" if r.html is None else r.html.encode()
                refers, digest = None, hashlib.sha1(payload).hexdigest()
                if left.get(digest, (0, 0))[1]:
                    refers = left[digest][0]
                    left[digest][1] -= 1
                times[digest, refers is None] = nth = times.get((digest, refers is None), -1) + 1
                raw = record(page_id, r.url, payload, refers, nth)
                if out is None:
                    out, sha1, count, size, first = store.open_output_stream(f"{base}/_temporary-{attempt}", compression=None), hashlib.sha1(), 0, 0, page_id
                out.write(raw)
                sha1.update(raw)
                count, size, last = count + 1, size + len(raw), page_id
                if size >= file_bytes:
                    close()
        close()
        yield pd.DataFrame(made, columns=["shard", "number", "path", "records", "bytes", "sha1", "first_id", "last_id"])

    parts = common.slices(spark, len(held.value), 1)
    ordered = both.repartitionById(parts, "shard").sortWithinPartitions("shard", "page_id", "kind", "html", "url")
    ordered.mapInPandas(save, MANIFEST).write.parquet(f"{folder}/manifest")
    drop_leftovers(folder)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def drop_leftovers(folder: str) -> None:
    """Remove what attempts that failed have left; committed files have other names."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if info.base_name.startswith("_temporary-"):
            store.delete_file(info.path)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of an archive; every length and digest is checked on the way."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    schema = RECORDS if payloads else RECORDS.rpartition(",")[0]
    names = [x.split()[0] for x in schema.split(", ")]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, records in zip(b["path"], b["records"], strict=True):
                out, size, n = [], 0, 0
                with store.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    for raw in members(stream):
                        row = parse(raw)
                        out.append(row[: len(names)])
                        n, size = n + 1, size + len(raw)
                        if len(out) >= 1000 or payloads and size >= 1 << 23:
                            yield pd.DataFrame(out, columns=names).astype({"refers_to": "Int64"})
                            out, size = [], 0
                if n != records:
                    raise ValueError(f"{path} has {n} records, the manifest {records}")
                yield pd.DataFrame(out, columns=names).astype({"refers_to": "Int64"})

    parts = common.slices(spark, files.count(), 1)
    return files.select("path", "records").repartitionByRange(parts, "path").mapInPandas(load, schema)
