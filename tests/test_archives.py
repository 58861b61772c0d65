"""Archives by ranges, the data source's reader and writer, and frames by need."""

import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from framelore.sources import archives, frames, manifests, shards

WRITTEN = archives.WRITTEN


def member_rows(clips, n, size=2000, shard=lambda c: c):
    side = lambda c, i: json.dumps({"clip_id": f"c{c}", "label": "fall", "frame_index": i})
    return [(shard(c), f"c{c}_t1_w000", i, bytes([c, i]) * (size // 2), side(c, i)) for c in range(clips) for i in range(n)]


@pytest.fixture
def written(spark, tmp_path):
    where = f"file://{tmp_path}/shards"
    shards.write_shards(spark.createDataFrame(member_rows(3, 40), WRITTEN), where)
    return where, tmp_path


def test_directory_names_every_member_by_its_bytes(spark, written):
    where, tmp_path = written
    rows = archives.directory(spark, where).collect()
    assert len(rows) == 3 * (40 * 2 + 1)
    for r in rows[::17]:
        data = open(r.path.removeprefix("file:").replace("//", "/"), "rb").read()
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            assert tar.extractfile(r.member).read() == data[r.offset : r.offset + r.size]


def test_bytes_read_follow_the_windows_asked_for(spark, written):
    where, tmp_path = written
    members = archives.write_directory(spark, where, f"file://{tmp_path}/dir")
    one = spark.createDataFrame([("c1_t1_w000",), ("none",)], "clip_key string")
    got = shards.window_frames(members, one).orderBy("frame_offset").collect()
    assert [(r.frame_offset, r.data[:2], json.loads(r.sidecar)["frame_index"]) for r in got] == [(i, bytes([1, i]), i) for i in range(40)]
    whole = sum(f.stat().st_size for f in (tmp_path / "shards").glob("*.tar"))
    read = sum(r.fetched for r in got)
    assert 40 * 2000 < read < whole / 3 + 1


def test_distant_members_are_read_apart(spark, tmp_path, monkeypatch):
    where = f"file://{tmp_path}/s"
    shards.write_shards(spark.createDataFrame(member_rows(1, 30, 100_000), WRITTEN), where)
    places = archives.images(archives.directory(spark, where)).where(F.col("stem").rlike("_00(02|03|25)$"))
    got = archives.read_members(places, tasks=1).orderBy("offset").collect()
    assert [len(r.data) for r in got] == [100_000] * 3 and all(r.sidecar for r in got)
    assert 300_000 < sum(r.fetched for r in got) < 320_000  # two neighbours and one far away, with their sidecars


def test_source_reads_archives_and_splits_alike(spark, written):
    where, tmp_path = written
    archives.register(spark)
    archives.write_directory(spark, where, f"file://{tmp_path}/dir", bytes_=20_000)
    cut = spark.read.parquet(f"file://{tmp_path}/dir/splits")
    assert cut.count() > 12
    whole = spark.read.format("tar_shards").load(where)
    pieces = spark.read.format("tar_shards").option("directory", f"file://{tmp_path}/dir").load()
    plain = lambda df: sorted((r.shard, r.member, r.stem, r.offset, r.size, bytes(r.data)) for r in df.collect())
    assert plain(whole) == plain(pieces) and len(plain(whole)) == 3 * 81
    assert pieces.rdd.getNumPartitions() == cut.count()


def test_archive_is_never_held_whole(written, monkeypatch):
    """The reader hands over batches of bounded size while it goes through an archive."""
    where, _ = written
    monkeypatch.setattr(archives, "BATCH", 10_000)
    reader = archives.TarReader({"path": where})
    sizes = [sum(batch.column("size").to_pylist()) for p in reader.partitions() for batch in reader.read(p)]
    assert len(sizes) > 20 and max(sizes) < 12_500


def test_equal_input_gives_equal_bytes_and_a_rerun_replaces(spark, written):
    where, tmp_path = written
    before = {f.name: f.read_bytes() for f in (tmp_path / "shards").glob("*.tar")}
    index = shards.write_shards(spark.createDataFrame(member_rows(3, 40)[::-1], WRITTEN), where, tasks=2)
    assert {f.name: f.read_bytes() for f in (tmp_path / "shards").glob("*.tar")} == before
    assert sorted((r.shard, r.members, r.bytes) for r in index.collect()) == [(n, 40, len(b)) for n, b in sorted(before.items())]


def test_failed_write_leaves_no_file(spark, tmp_path):
    rows = spark.createDataFrame(member_rows(4, 5), WRITTEN)
    bad = rows.withColumn("sidecar", F.when((F.col("shard_index") == 3) & (F.col("frame_offset") == 4), F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("sidecar")))
    with pytest.raises(Exception, match="broken"):
        shards.write_shards(bad, f"file://{tmp_path}/out", tasks=4)
    assert [f for _, _, names in os.walk(tmp_path / "out") for f in names] == []


def test_shards_dealt_to_several_tasks_are_refused(spark, tmp_path):
    archives.register(spark)
    rows = spark.createDataFrame(member_rows(2, 6, shard=lambda c: 0), WRITTEN).repartition(2, "frame_offset").sortWithinPartitions("shard_index")
    with pytest.raises(Exception, match="several tasks"):
        rows.write.format("tar_shards").mode("overwrite").save(f"file://{tmp_path}/out")
    assert not list((tmp_path / "out").glob("*.tar"))


def test_empty_input_writes_nothing_and_reads_as_nothing(spark, tmp_path):
    index = shards.write_shards(spark.createDataFrame([], WRITTEN), f"file://{tmp_path}/out")
    assert index.count() == 0 and shards.read_shards(spark, f"file://{tmp_path}/out").count() == 0


def test_null_sidecars_and_repeated_members(spark, tmp_path):
    rows = [(0, "k", 0, b"a", None), (0, "k", 1, b"b", '{"x":1}'), (0, "k", 1, b"c", '{"x":2}')]
    where = f"file://{tmp_path}/out"
    shards.write_shards(spark.createDataFrame(rows, WRITTEN), where)
    got = sorted((r.stem, bytes(r.data), r.sidecar) for r in shards.read_shards(spark, where).collect())
    assert [g[0] for g in got] == ["k_0000", "k_0001", "k_0001"] and got[0][2] is None and {g[1] for g in got[1:]} == {b"b", b"c"}


# --- frames by need ----------------------------------------------------------------------------------------------------


def test_local_copies_come_before_the_source(spark, tmp_path):
    for i in range(1, 6):
        folder = tmp_path / "src" / "clip"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"img_{i:03d}.png").write_bytes(b"source%d" % i)
    local = tmp_path / "local" / "crops_clip"
    local.mkdir(parents=True)
    (local / "frame_00002.png").write_bytes(b"local2")
    (local / "notes.png").write_bytes(b"no frame")
    windows = spark.createDataFrame([("clip", [1, 2, None]), ("clip", [2, 3, 9]), ("gone", [0]), ("clip", None)], "clip_id string, frame_indices array<long>")
    needed = frames.needed_frames(windows)
    files = lambda name: manifests.list_files(spark, f"file://{tmp_path}/{name}")
    at = frames.locate(needed, frames.staged_frames(files("local")), frames.file_frames(files("src"))).cache()
    assert sorted(tuple(r) for r in frames.missing_frames(at).collect()) == [("clip", 9), ("gone", 0)]
    got = {(r.clip_id, r.frame_index): (r.copy, bytes(r.data)) for r in frames.fetch(at).collect()}
    assert got == {("clip", 1): (1, b"source2"), ("clip", 2): (0, b"local2"), ("clip", 3): (1, b"source4")}
    assert frames.locate(needed.limit(0), frames.staged_frames(files("local"))).count() == 0
