"""Writers and readers: round trips of manifests, shards and artefacts, and what they refuse."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framelore.functions import scalars, slices
from framelore.operators import datasets, manifest
from framelore.sources import artifacts, manifests, shards, store


def folders(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "folder string")


def test_manifest_from_folders_written_and_read(spark, tmp_path):
    m = manifests.build_manifest(folders(spark, "Fall-02-cam0-rgb", "adl-11-cam0-rgb", "adl-11-cam0-rgb (1)", "notes"))
    manifests.write_manifest(m, f"file://{tmp_path}/m")
    text = next((tmp_path / "m").glob("part-*")).read_text()
    for kind in ("json", "yaml"):
        (tmp_path / f"m.{kind}").write_text(text)
        back = manifests.read_manifest(spark, f"file://{tmp_path}/m.{kind}").orderBy("pos").collect()
        assert [(r.pos, r.clip_id, r.label, r.schema_version) for r in back] == [
            (0, "urfd-debug-adl-11-cam0-rgb", "no_fall", "1.1"), (1, "urfd-debug-fall-02-cam0-rgb", "fall", "1.1"),
        ]
    assert not manifest.frozen_present(m)
    lines = manifests.read_clips(spark, manifests.write_clips(m, f"file://{tmp_path}/lines"))
    assert sorted(map(repr, lines.collect())) == sorted(map(repr, m.select(lines.columns).collect()))


@pytest.mark.parametrize("names", [(), ("notes", "walk-01")])
def test_no_manifest_without_clips(spark, names):
    with pytest.raises(ValueError):
        manifests.build_manifest(folders(spark, *names))


@pytest.mark.parametrize("name, text", [("a.yaml", "- 1\n"), ("b.yaml", "schema_version: '1.1'\n"), ("c.json", '{"schema_version": "1.1"}')])
def test_manifest_of_the_wrong_shape_is_an_error(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    with pytest.raises(PySparkException):
        manifests.read_manifest(spark, f"file://{tmp_path}/{name}").collect()


def test_expected_files(spark):
    found = {r.path for r in manifests.expected_files(spark, "/d/", "/l", ".done", ("falls.csv", "adls.csv")).collect()}
    assert len(found) == 73 and {"/d/.done", "/l/adls.csv", "/d/fall-30-cam0-rgb", "/d/adl-40-cam0-rgb"} <= found


def test_shards_are_written_by_tasks_and_read_back(spark, tmp_path):
    side = lambda clip, i: json.dumps({"clip_id": clip, "label": "fall", "frame_index": i})
    rows = [(s, f"c{s}_t1_w000", i, b"x%d" % i, side(f"c{s}", 10 + i)) for s in (0, 1) for i in (2, 0, 1)]
    m = spark.createDataFrame(rows, "shard_index long, clip_key string, frame_offset int, data binary, sidecar string")
    where = f"file://{tmp_path}/s"
    for _ in range(2):  # the second run puts the same files in place
        index = shards.write_shards(m, where).orderBy("shard").collect()
    assert [(r.shard, r.clip_keys, r.members) for r in index] == [("shard-0000.tar", ["c0_t1_w000"], 3), ("shard-0001.tar", ["c1_t1_w000"], 3)]
    assert sorted(p.name for p in (tmp_path / "s").glob("*shard*") if not p.name.startswith(".")) == ["shard-0000.tar", "shard-0001.tar"]
    assert index[0].bytes == (tmp_path / "s" / "shard-0000.tar").stat().st_size
    back = datasets.window_rows(shards.read_shards(spark, where)).orderBy("clip_key").collect()
    assert [(r.clip_key, r.clip_id, r.source_label, r.frame_indices) for r in back] == [(f"c{s}_t1_w000", f"c{s}", "fall", [10, 11, 12]) for s in (0, 1)]


def test_sidecars_need_their_fields(spark):
    m = spark.createDataFrame([("a_0000", '{"clip_id":"a","label":"fall"}')], "stem string, sidecar string")
    with pytest.raises(PySparkException):
        datasets.window_rows(m).collect()


def test_artifacts(spark, tmp_path):
    results = spark.createDataFrame(
        [("a", 0, [[0.0, 0.0, 4.0, 4.0], [1.0, 1.0, 2.0, 2.0]], [0.9, 0.8], [0, 7], [5]), ("a", 1, [], [], [], None), ("b", 0, [[1.0, 2.0]], [0.5], [0], None), ("b", 1, None, None, None, None)],
        "clip_id string, frame_index int, xyxy array<array<double>>, conf array<double>, cls array<int>, ids array<int>",
    )
    flat = artifacts.flatten_detections(results)
    got = sorted((r.clip_id, r.frame_index, r.decoded_ok, r.track_id, r.x_max) for r in flat.collect())
    assert got == [("a", 0, True, 5, 4.0), ("a", 1, True, None, None), ("b", 0, False, None, None), ("b", 1, False, None, None)]
    runs = spark.createDataFrame([("a", 2, 0, 4.0), ("b", 2, 2, 0.0)], "clip_id string, frame_count int, decode_failures int, elapsed_seconds double")
    meta = artifacts.run_meta(flat, runs)
    a, b = meta.orderBy("clip_id").collect()
    assert (a.detection_count, a.track_count, a.fps, a.latency_ms_per_frame) == (1, 1, 0.5, 2000.0) and (b.detection_count, b.fps) == (0, None)
    boxes = flat.where("ord is not null").drop("decoded_ok")
    paths = artifacts.write_artifacts(f"file://{tmp_path}/out", detections=boxes, run_meta=meta)
    assert [(r.clip_id, r.track_id, r.x_max) for r in manifests.read_detections(spark, paths["detections"]).collect()] == [("a", 5, 4.0)]
    with pytest.raises(ValueError):
        artifacts.write_artifacts(str(tmp_path), boxes=flat)


def test_run_summary(spark, tmp_path):
    clips = spark.createDataFrame([("a", 3, None), ("b", 0, None), ("c", None, "no frames")], "clip_id string, windows int, error string")
    path = artifacts.write_run_summary(clips, f"file://{tmp_path}/summary")
    assert json.loads(spark.read.text(path).first().value) == {"clips": 3, "failed": 1, "empty": 1, "windows": 3, "errors": [{"clip_id": "c", "error": "no frames"}]}


def test_scalars_of_runs_and_slices(spark):
    one = spark.range(1)
    low, tracker, end = F.lit(0.1), F.lit("other.yaml"), F.lit(None).cast("boolean")
    got = one.select(artifacts.fallback_used(low, tracker, end), artifacts.fallback_used(F.lit(None).cast("double"), F.lit(None).cast("string"), end)).first()
    assert tuple(got) == ("track_low_thresh=0.1, tracker=other.yaml", None)
    assert one.select(slices.slice_from_json(F.lit('{"tag":"a"}'), strict=False).alias("k")).first().k is None
    with pytest.raises(PySparkException):
        one.select(slices.slice_from_json(F.lit("x"))).collect()
    with pytest.raises(PySparkException):
        one.select(slices.numeric_value(F.lit(None).cast("double"), F.lit("one class"))).collect()
    names = "clip_id dataset label source_path track_id frame_index frame_offset window_index missing_frame coverage margin_used shard_filename".split()
    text = one.select(scalars.sidecar({n: F.lit(n) for n in names}, {n: F.lit(1) for n in ("output_size", "margin", "clip_length")})).first()[0]
    assert json.loads(text) == {n: n for n in names} | {"crop_config": {"output_size": 1, "margin": 1, "clip_length": 1}}


def test_payload_that_cannot_be_read_is_an_error(spark):
    bad = spark.createDataFrame([('{"format_version":"2.0"}',)], "payload string")
    with pytest.raises(PySparkException):
        store.payload_metrics(bad).collect()
    meta = spark.range(1).select(store.run_metadata(F.lit("r"), F.lit("m"), F.lit("root"), F.lit(None).cast("string")).alias("m")).first().m
    assert meta.context == "unknown" and meta.created_at.endswith("+00:00")


def test_levels_and_batches(spark):
    w = spark.createDataFrame([("k1", 1), ("k2", 2)], "clip_key string, v int")
    keys = spark.createDataFrame([(0, "k2"), (1, "k1"), (2, "k2"), (3, "k9")], "pos int, clip_key string")
    assert [(r.pos, r.v) for r in datasets.batch(w, keys).collect()] == [(0, 2), (1, 1), (2, 2)]
    assert [r.pos for r in datasets.missing_keys(w, keys).collect()] == [3]
    assert sorted(r.level for r in datasets.both_levels(w, w).collect()) == ["clip", "clip", "window", "window"]


def test_folders_are_staged_laid_out_and_listed(spark, tmp_path):
    for name in ("a/x_1.png", "a/notes.txt", "b/b/y_1.PNG", "b/b/y_2.png", "c/1/z.png", "c/2/z.png", "d/deep/er/z.png", "e/only.txt", "labels/falls.csv", "labels/ADLS.CSV", "labels/old/falls.csv", "labels/x.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    root = f"file:{tmp_path}"
    files = manifests.list_files(spark, root)
    got = {r.clip: (r.layout, r.frames) for r in manifests.frame_layout(manifests.folder_entries(files, root)).collect()}
    assert {k: got[k] for k in "abcde"} == {"a": ("flat", 1), "b": ("nested:b", 2), "c": ("missing", 0), "d": ("missing", 0), "e": ("missing", 0)}
    assert sorted(r.name for r in manifests.label_files(files, f"{root}/labels/").collect()) == ["ADLS.CSV", "falls.csv"]
    expected = spark.createDataFrame([(f"{root}/a/x_1.png",), (f"{root}/labels/falls.csv",)], "path string")
    assert manifests.staged(expected, files)
    more = expected.unionAll(spark.createDataFrame([(f"{root}/gone",)], "path string"))
    assert not manifests.staged(more, files) and [r.path for r in manifests.missing_files(more, files).collect()] == [f"{root}/gone"]
    assert manifests.frame_layout(manifests.folder_entries(files.limit(0), root)).count() == 0


def test_batches_are_sorted_each_alone(spark):
    w = spark.createDataFrame([(f"k{i}", i) for i in range(20)], "clip_key string, v int")
    keys = spark.createDataFrame([(p, f"k{(p * 7) % 23}") for p in range(60)], "pos long, clip_key string")
    out = datasets.batches(w, keys, 16).mapInPandas(lambda it: (p.assign(part=__import__("pyspark").TaskContext.get().partitionId()) for p in it), "clip_key string, pos long, v int, batch long, part int").collect()
    parts = {}
    for r in out:
        parts.setdefault((r.batch, r.part), []).append(r.pos)
    assert len({b for b, _ in parts}) == len(parts) == 4 and all(p == sorted(p) for p in parts.values())
    assert sorted(r.pos for r in out) == [p for p in range(60) if (p * 7) % 23 < 20]


def test_readable_payloads_and_the_rest(spark):
    good = '{"format_version":"1.0","metadata":{"run_id":"r","model_id":"m"},"metrics":[{"name":"f1","value":0.5}]}'
    rows = spark.createDataFrame([(1, good), (2, "x"), (3, None), (4, '{"format_version":"1.0","metadata":{"run_id":"r"},"metrics":[]}')], "id int, payload string")
    got = sorted((r.id, r.run_id, r.name, r.value) for r in store.readable_metrics(rows).collect())
    assert got == [(1, "r", "f1", 0.5), (2, None, None, None), (3, None, None, None), (4, "r", None, None)]


def test_large_clips_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(artifacts, "FRAMES", 50)
    d = spark.range(400).select(F.lit("a").alias("clip_id"), F.col("id").cast("int").alias("frame_index"), F.lit(1).alias("track_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together
    try:
        path = artifacts.write_artifacts(f"file://{tmp_path}/out", detections=d)["detections"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out" / "detections" / "clip_id=a").glob("part-*"))) > 1 and manifests.read_detections(spark, path).count() == 400
