"""WARC records and a Merkle fixity audit of replicas.

The leaves of an archive's tree are its ranges of ``RANGE`` bytes of offsets: a leaf hashes the offsets, lengths and
SHA-256 of the records that begin in it, in order.  An inner node hashes the ordered nodes of the ``FAN`` ranges below
it.  Replicas whose roots agree are the same; elsewhere the audit descends only under nodes that differ, down to records.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.llm.common import drop, save
from framelore.sources.archives import store_of

RANGE, FAN = 1 << 16, 16
#: Bytes that are read of an archive at once, and of the records that are handed over together.
SLICE, BATCH = 1 << 16, 1 << 24
RECORDS = "archive string, offset long, length long, headers map<string,string>, record binary"


def warc_record(target: Column, payload: Column, record_id: Column, date: Column, content_type: str = "text/html; charset=utf-8") -> Column:
    """A WARC/1.1 resource record as bytes: header lines, an empty line, the payload and two line ends."""
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(target, F.lit("")), r"[\r\n]", "%0A"),
        F.lit("\r\nWARC-Date: "), date, F.lit("\r\nWARC-Record-ID: <urn:uuid:"), record_id, F.lit(f">\r\nContent-Type: {content_type}\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def lay_out(rows: DataFrame, order: str) -> DataFrame:
    """Rows (archive, length, ...) with the offset of each record, laid one after the other in an archive by ``order``.

    An archive has a bounded number of rows; rows should be narrow, with hashes in place of the records.
    """
    upto = W.partitionBy("archive").orderBy(order, "length").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("offset", F.sum("length").over(upto) - F.col("length"))


def parse_warc(data: bytes | BinaryIO) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, record with its head) of each record; gzip members are records of their own.

    data: bytes, or a file that is read in slices of SLICE bytes, of which one record is held at a time.  Offsets and lengths
    are those of the file's bytes.  Broken tails end the archive with a record of what is left.  No bytes: no records.
    """
    file = io.BytesIO(data) if isinstance(data, (bytes, bytearray)) else data
    at, held, more = 0, bytearray(), True

    def fill() -> bool:
        nonlocal more
        part = file.read(SLICE) if more else b""
        more = bool(part)
        held.extend(part)
        return more

    while held or fill():
        while len(held) < 2 and fill():
            pass
        if held[:2] == b"\x1f\x8b":
            unpacker, parts, used = zlib.decompressobj(31), [], 0
            try:
                while not unpacker.eof and (used < len(held) or fill()):
                    parts.append(unpacker.decompress(bytes(held[used : used + SLICE])))
                    used = min(len(held), used + SLICE)
                record, length = b"".join(parts), used - len(unpacker.unused_data)
            except zlib.error:
                while fill():
                    pass
                yield at, len(held), {}, bytes(held)
                return
        else:
            end = held.find(b"\r\n\r\n")
            while end < 0 and fill():
                end = held.find(b"\r\n\r\n", max(0, len(held) - SLICE - 3))
            size = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", bytes(held[:end]).replace(b"\r\n", b"\n")) if end >= 0 else None
            while (size is None or len(held) < end + 8 + int(size[1])) and fill():
                pass
            length = min(len(held), end + 8 + int(size[1])) if size else len(held)
            record = bytes(held[:length])
        head = record.partition(b"\r\n\r\n")[0].decode("utf-8", "replace").split("\r\n")
        yield at, length, dict(x.split(": ", 1) for x in head[1:] if ": " in x), record
        at += length
        del held[:length]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files below a path, plain or gzip by record: archive, offset, length, headers, record.

    Archives may be of any size: a task goes through a file in slices and holds the records of a batch, about BATCH bytes;
    a record has to fit a task.  Repeated and empty records are records; an empty file has none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    names = ["archive", "offset", "length", "headers", "record"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["path"]:
                store, where = store_of(name)
                rows: list[tuple] = []
                with store.open_input_file(where) as file:
                    held = 0
                    for x in parse_warc(file):
                        rows.append((name.rpartition("/")[2], *x))
                        held += len(x[3])
                        if held >= BATCH:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    return files.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, RECORDS)


def write_warc(records: DataFrame, path: str, compress: bool = True) -> DataFrame:
    """Write records (archive, offset, record), a file per archive in the order of offsets; rows (archive, records, bytes).

    A task writes an archive record by record, so that only records have to fit it; the file gets its name when it is
    whole, and a task that runs again does no harm.  Only names and counts leave the tasks.  Null records are empty and are not written;
    repeated ones are written as they come; rows with null archive are left out; no rows: no files.
    """
    root = path.rstrip("/")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = store_of(root)
        store.create_dir(folder, recursive=True)
        now = out = part = None
        count = 0

        def close() -> pd.DataFrame:
            size = out.tell()
            out.close()
            store.move(part, f"{folder}/{now}")
            return pd.DataFrame({"archive": [now], "records": [count], "bytes": [size]})

        for pdf in batches:
            for archive, record in zip(pdf["archive"], pdf["record"]):
                if archive != now:
                    if out is not None:
                        yield close()
                    now, count, part = archive, 0, f"{folder}/_{archive}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(part)
                if record is not None:
                    out.write(gzip.compress(record, mtime=0) if compress else record)
                    count += 1
        if out is not None:
            yield close()

    rows = records.where("archive is not null").select("archive", "offset", "record").repartition("archive").sortWithinPartitions("archive", "offset", "record")
    return save(rows.mapInPandas(write, "archive string, records long, bytes long"), "warc")


def record_hashes(records: DataFrame) -> DataFrame:
    """Rows (archive, offset, length, sha256) of records (archive, offset, length, record)."""
    return records.select("archive", "offset", "length", F.sha2("record", 256).alias("sha256"))


def _nodes(below: DataFrame) -> DataFrame:
    """The next level: rows (archive, node, left, right), where left and right hash the ordered children."""

    def digest(side: str) -> Column:
        children = F.sort_array(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("node", side))))
        joined = F.array_join(F.transform(children, lambda x: F.concat_ws(":", x["node"].cast("string"), x[side])), "\n")
        return F.when(F.count(side) > 0, F.sha2(joined, 256)).alias(side)

    return below.groupBy("archive", F.floor(F.col("node") / FAN).alias("up")).agg(digest("left"), digest("right")).withColumnRenamed("up", "node")


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (archive, offset, length, kind, left_sha256, right_sha256) where two replicas' records differ.

    left, right: record_hashes() of the replicas.  kind: corrupt (other bytes at the offset), missing (not in right),
    extra (not in left).  Rows with null archive or offset are left out; a record that is listed twice counts as one
    with both hashes; a null hash is a value of its own.  Two empty replicas agree.
    """
    both = left.select("archive", "offset", "length", "sha256", F.lit(True).alias("of_left")).union(right.select("archive", "offset", "length", "sha256", F.lit(False)))
    both = save(both.where("archive is not null and offset is not null"), "fixity")
    leaf = F.concat_ws(":", F.col("offset").cast("string"), F.coalesce(F.col("length").cast("string"), F.lit("-")), F.coalesce("sha256", F.lit("-")))

    def side(own: Column) -> Column:
        rows = F.sort_array(F.collect_list(F.when(own, F.struct("offset", leaf.alias("leaf")))))
        return F.when(F.count(F.when(own, 1)) > 0, F.sha2(F.array_join(F.transform(rows, lambda x: x["leaf"]), "\n"), 256))

    level = both.groupBy("archive", F.floor(F.col("offset") / RANGE).alias("node")).agg(side(F.col("of_left")).alias("left"), side(~F.col("of_left")).alias("right"))
    levels = [save(level, "fixity")]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top:
        levels.append(save(_nodes(levels[-1]), "fixity"))
        top //= FAN
    differ = levels[-1].where(~F.col("left").eqNullSafe(F.col("right"))).select("archive", "node")
    for lower in levels[-2::-1]:
        up = differ.select(F.col("archive").alias("__a"), F.col("node").alias("__n"))
        below = lower.join(up, (F.col("archive") == F.col("__a")) & (F.floor(F.col("node") / FAN) == F.col("__n")), "left_semi")
        differ = below.where(~F.col("left").eqNullSafe(F.col("right"))).select("archive", "node")
    differ = save(differ.toDF("__a", "__n"), "fixity")
    for x in levels:
        drop(x)
    rows = both.join(differ, (F.col("archive") == F.col("__a")) & (F.floor(F.col("offset") / RANGE) == F.col("__n")), "left_semi")

    def of(own: Column) -> Column:
        found = F.sort_array(F.collect_set(F.when(own, F.coalesce("sha256", F.lit("null")))))
        return F.when(F.size(found) > 0, F.array_join(found, ","))

    records = rows.groupBy("archive", "offset").agg(
        F.coalesce(F.max(F.when(F.col("of_left"), F.col("length"))), F.max("length")).alias("length"),
        of(F.col("of_left")).alias("left_sha256"), of(~F.col("of_left")).alias("right_sha256"),
    )
    kind = F.when(F.col("right_sha256").isNull(), "missing").when(F.col("left_sha256").isNull(), "extra").otherwise("corrupt")
    return records.where(~F.col("left_sha256").eqNullSafe(F.col("right_sha256"))).select("archive", "offset", "length", kind.alias("kind"), "left_sha256", "right_sha256")


def record_uuid(key: Column) -> Column:
    """A stable UUID-shaped id."""
    h = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.concat_ws("-", *(F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
