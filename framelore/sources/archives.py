"""Tar archives without whole archives in memory: a directory of member offsets, a data source, reads of needed ranges only.

* ``directory()`` walks headers once and gives a row per member with the place of its bytes; ``write_directory()`` keeps it,
  with splits of archives that end at members.
* The data source ``tar_shards`` yields members as they are read, archive by archive or split by split, and writes archives
  member by member: files get their names when all tasks have succeeded, and those of a failed write go.
* ``read_members()`` reads the bytes of chosen members: tasks get neighbouring members and fetch them as one range.

Tasks open files with Arrow's file systems (local, HDFS, S3, GCS, Azure).
"""

from __future__ import annotations

import io
import json
import re
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from framelore.functions.scalars import shard_name

MANIFEST, NAME = "_manifest.json", "tar_shards"
MEMBERS = "path string, member string, header long, offset long, size long"
READ = "shard string, member string, stem string, offset long, size long, data binary"
WRITTEN = "shard_index long, clip_key string, frame_offset int, data binary, sidecar string"
INDEX = "shard string, clip_keys array<string>, members long, bytes long"
#: Bytes of a split of an archive and of a batch of rows; bytes between members that are read along with them; range read at most at once.
SPLIT, BATCH, GAP, RANGE = 1 << 26, 1 << 24, 1 << 16, 1 << 23


def store_of(path: str):
    """(file system, path in it) of a path as Spark names it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path) if ":" in path else f"file://{path}")


def _headers(file, stop: int | None = None) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    """Files of an archive from the current place on, up to members whose header lies at ``stop`` or later."""
    with tarfile.open(fileobj=file, mode="r:") as tar:
        while (m := tar.next()) is not None and (stop is None or m.offset < stop):
            tar.members = []  # else it remembers all
            if m.isfile():
                yield tar, m


def directory(spark: SparkSession, path: str, pattern: str = "*.tar") -> DataFrame:
    """(path, member, header, offset, size) of the members of all archives below a path; only headers are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["path"]:
                store, where = store_of(name)
                with store.open_input_file(where) as file:
                    rows = []
                    for _, m in _headers(file):
                        rows.append((name, m.name, m.offset, m.offset_data, m.size))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["path", "member", "header", "offset", "size"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["path", "member", "header", "offset", "size"])

    return files.repartition(spark.sparkContext.defaultParallelism).mapInPandas(walk, MEMBERS)


def splits(members: DataFrame, bytes_: int = SPLIT) -> DataFrame:
    """(path, start, stop, members): each archive in pieces of about so many bytes that begin at a member's header."""
    return members.groupBy("path", F.floor(F.col("header") / bytes_).alias("piece")).agg(
        F.min("header").alias("start"), (F.max("header") + 1).alias("stop"), F.count("*").alias("members")
    ).drop("piece")


def write_directory(spark: SparkSession, path: str, out: str, bytes_: int = SPLIT) -> DataFrame:
    """Keep directory() below out/members and splits() below out/splits; the directory."""
    directory(spark, path).write.mode("overwrite").parquet(f"{out}/members")
    members = spark.read.parquet(f"{out}/members")
    splits(members, bytes_).write.mode("overwrite").parquet(f"{out}/splits")
    return members


def images(members: DataFrame) -> DataFrame:
    """(path, member, stem, offset, size, sidecar_offset, sidecar_size): members that are no JSON, each with its archive's JSON of the same stem."""
    stem = F.regexp_replace("member", r"\.[^./]*$", "")
    rows = members.where(F.col("member") != MANIFEST).withColumn("stem", stem).withColumn("json", F.col("member").endswith(".json"))
    sidecars = rows.where("json").groupBy("path", "stem").agg(F.max(F.struct("offset", "size")).alias("s"))  # the last of a name counts
    found = rows.where("not json").join(sidecars, ["path", "stem"], "left")
    return found.select("path", "member", "stem", "offset", "size", F.col("s.offset").alias("sidecar_offset"), F.col("s.size").alias("sidecar_size"))


def _fetch(rows: list[dict]) -> tuple[list[tuple[bytes, bytes | None]], int]:
    """(data, sidecar) of rows of one file, by merged ranges, and the bytes fetched."""
    wanted = sorted({(r["offset"], r["size"]) for r in rows} | {(r["sidecar_offset"], r["sidecar_size"]) for r in rows if r.get("sidecar_offset") is not None})
    ranges: list[list[int]] = []
    for offset, size in wanted:
        if ranges and offset - ranges[-1][1] <= GAP and offset + size - ranges[-1][0] <= RANGE:
            ranges[-1][1] = max(ranges[-1][1], offset + size)
        else:
            ranges.append([offset, offset + size])
    store, where = store_of(rows[0]["path"])
    parts, at, fetched = {}, 0, 0
    with store.open_input_file(where) as file:
        for begin, end in ranges:
            file.seek(begin)
            data = file.read(end - begin)
            if len(data) < end - begin:
                raise EOFError(f"{rows[0]['path']} ends before byte {end}")
            fetched += len(data)
            while at < len(wanted) and wanted[at][0] + wanted[at][1] <= end:
                offset, size = wanted[at]
                parts[wanted[at]] = data[offset - begin : offset - begin + size]
                at += 1
    side = lambda r: parts[r["sidecar_offset"], r["sidecar_size"]] if r.get("sidecar_offset") is not None else None
    return [(parts[r["offset"], r["size"]], side(r)) for r in rows], fetched


def read_members(places: DataFrame, tasks: int | None = None) -> DataFrame:
    """places (path, offset, size, perhaps sidecar_offset and sidecar_size, others) with data, sidecar and fetched.

    fetched: bytes of the ranges that were read from the row on, 0 where an earlier row's range covers it; its sum is what
    was read.  Neighbours go to the same task.  tasks: by default one for each 128 MiB wanted, and no fewer than cores.  Rows
    with null path get nulls.
    """
    spark = places.sparkSession
    if tasks is None:
        tasks = max(spark.sparkContext.defaultParallelism, (places.agg(F.sum("size")).first()[0] or 0) // (1 << 27) + 1)
    schema = T.StructType([*places.schema.fields, T.StructField("data", T.BinaryType()), T.StructField("sidecar", T.StringType()), T.StructField("fetched", T.LongType())])
    arrow = pa.schema([("data", pa.binary()), ("sidecar", pa.string()), ("fetched", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, begin = batch.select([c for c in ("path", "offset", "size", "sidecar_offset", "sidecar_size") if c in batch.schema.names]).to_pylist(), 0
            while begin < len(rows):
                end, held = begin, 0
                while end < len(rows) and rows[end]["path"] == rows[begin]["path"] and (end == begin or held + rows[end]["size"] <= BATCH):
                    held, end = held + (rows[end]["size"] or 0), end + 1
                parts, fetched = _fetch(rows[begin:end]) if rows[begin]["path"] is not None else ([(None, None)] * (end - begin), 0)
                new = [pa.array([d for d, _ in parts], pa.binary()), pa.array([s and s.decode() for _, s in parts], pa.string()), pa.array([fetched] + [0] * (end - begin - 1), pa.int64())]
                old = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*old.columns, *new], names=[*old.schema.names, *arrow.names])
                begin = end

    dealt = places.repartition(int(tasks), "path", F.floor(F.col("offset") / SPLIT)).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(run, schema)


# --- data source -------------------------------------------------------------------------------------------------------


@dataclass
class Piece(InputPartition):
    path: str
    start: int = 0
    stop: int | None = None


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (temporary name, name, clip keys, members, bytes)."""

    files: list[tuple[str, str, list[str], int, int]]


class TarReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.directory = options.get("path"), options.get("directory")
        if not self.path and not self.directory:
            raise ValueError("tar_shards needs a path or a directory")

    def partitions(self) -> list[Piece]:
        """A split each where a directory is given, else an archive each.  Names only: no archive is opened here."""
        from pyarrow import dataset, fs

        if self.directory:
            store, where = store_of(self.directory)
            rows = dataset.dataset(f"{where}/splits", filesystem=store, format="parquet").to_table(columns=["path", "start", "stop"]).to_pylist()
            return [Piece(r["path"], r["start"], r["stop"]) for r in rows]
        store, where = store_of(self.path)
        info = store.get_file_info(where)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(where, recursive=True))
        prefix = self.path[: len(self.path) - len(where)] if self.path.endswith(where) else ""
        hidden = lambda p: any(x[:1] in ("_", ".") for x in p[len(where) :].split("/"))
        return [Piece(prefix + f.path) for f in found if f.type == fs.FileType.File and f.path.endswith(".tar") and (f is info or not hidden(f.path))]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        """Members as they are read, in batches of about BATCH bytes."""
        store, where = store_of(partition.path)
        shard, rows, held = partition.path.rpartition("/")[2], [], 0
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = ["shard", "member", "stem", "offset", "size", "data"]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
        with store.open_input_file(where) as file:
            file.seek(partition.start)
            for tar, m in _headers(file, partition.stop):
                rows.append((shard, m.name, re.sub(r"\.[^./]*$", "", m.name), m.offset_data, m.size, tar.extractfile(m).read()))
                held += m.size
                if held >= BATCH:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class TarWriter(DataSourceWriter):
    """Rows of WRITTEN that come sorted by shard, key and offset: a file per shard, each member written as it comes."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.width, self.overwrite, self.run = options["path"].rstrip("/"), int(options.get("width", 4)), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        files, now, tar, out, part = [], None, None, None, None
        keys: list[str] = []
        count = 0

        def add(name: str, data: bytes) -> None:
            info = tarfile.TarInfo(name)
            info.size, info.mtime, info.mode = len(data), 0, 0o644
            tar.addfile(info, io.BytesIO(data))
            tar.members = []

        def close() -> None:
            add(MANIFEST, json.dumps({"clip_keys": keys, "members": count}, sort_keys=True).encode())
            tar.close()
            size = out.tell()
            out.close()
            files.append((part, f"{folder}/{_shard(now, self.width)}", keys, count, size))

        try:
            for r in rows:
                if r.shard_index != now:
                    if tar is not None:
                        close()
                    now, keys, count, part = r.shard_index, [], 0, f"{folder}/_{self.run}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(part)
                    tar = tarfile.open(fileobj=out, mode="w|")
                if not keys or keys[-1] != r.clip_key:
                    keys.append(r.clip_key)
                count += 1
                add(f"{r.clip_key}_{r.frame_offset:04d}.jpg", bytes(r.data))
                if r.sidecar is not None:
                    add(f"{r.clip_key}_{r.frame_offset:04d}.json", r.sidecar.encode())
            if tar is not None:
                close()
        except BaseException:
            for name in [f[0] for f in files] + [part] * (part is not None):
                if store.get_file_info(name).type.name == "File":
                    store.delete_file(name)
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """All tasks have succeeded: files get their names, then the index is put beside them."""
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        if len({f[1] for f in files}) < len(files):
            self.abort(messages)
            raise ValueError("a shard came from several tasks: rows have to be dealt by shard_index")
        for part, name, *_ in files:
            store.move(part, name)
        self._tidy(store, folder)
        lines = "".join(json.dumps({"shard": n.rpartition("/")[2], "clip_keys": k, "members": m, "bytes": b}) + "\n" for _, n, k, m, b in files)
        store.create_dir(f"{folder}/_index", recursive=True)
        name = f"{folder}/_index/{'index' if self.overwrite else self.run}.json"
        with store.open_output_stream(f"{name}.part") as out:
            out.write(lines.encode())
        store.move(f"{name}.part", name)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = store_of(self.path)
        for m in messages:
            for part, *_ in m.files if m else ():
                if store.get_file_info(part).type.name == "File":
                    store.delete_file(part)
        self._tidy(store, folder)

    def _tidy(self, store, folder: str) -> None:
        """Files of attempts whose results did not count."""
        from pyarrow import fs

        for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.run}-"):
                store.delete_file(f.path)


class TarShards(DataSource):
    """spark.read.format("tar_shards"): options path, or directory (that write_directory() kept).  Writing: options path and width."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return READ

    def reader(self, schema: T.StructType) -> TarReader:
        return TarReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> TarWriter:
        return TarWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarShards)


def _shard(index: int, width: int) -> str:
    return f"shard-{index:0{width}d}.tar"


def write_shards(members: DataFrame, path: str, width: int = 4, tasks: int | None = None) -> DataFrame:
    """Write members (shard_index, clip_key, frame_offset, data, sidecar JSON) as tar archives; the index (shard, clip_keys, members, bytes).

    A shard is written by one task, member by member, in the order of key and offset with fixed times and modes, so equal
    input gives equal bytes.  All files appear after the last task has succeeded; a failed write leaves none.
    """
    spark = members.sparkSession
    register(spark)
    rows = members.select(F.col("shard_index").cast("long"), "clip_key", F.col("frame_offset").cast("int"), "data", "sidecar")
    rows = rows.repartition(tasks or spark.sparkContext.defaultParallelism, "shard_index").sortWithinPartitions("shard_index", "clip_key", "frame_offset")
    rows.write.format(NAME).option("width", str(width)).mode("overwrite").save(path)
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).json(f"{path.rstrip('/')}/_index")
