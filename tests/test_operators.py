"""Hand-made cases of the library's operators."""

import random

import pytest
from pyspark.sql import functions as F

from framelore.functions import na, scalars
from framelore.operators import classification as clf
from framelore.operators import events, examples, labels, manifest, selftest, tracks, windows
from framelore.sources import manifests, shards, store


def scores(spark, values, clip=1):
    return spark.createDataFrame([(clip, i, float(v)) for i, v in enumerate(values)], "clip_id long, pos long, score double")


def alert_list(df):
    return sorted(r.alert for r in df.collect())


@pytest.mark.parametrize(
    "values, threshold, want",
    [
        ([0.95] * 13 + [0.2], 0.8, [9]), ([0.7] * 22 + [0.3], 0.5, [9, 19]), ([0.83] * 9 + [0.0] + [0.99] * 9, 0.8, []),
        ([float("nan")] * 30, 0.8, []), ([], 0.8, []),
    ],
)
def test_alerts(spark, values, threshold, want):
    assert alert_list(events.alerts(scores(spark, values), threshold)) == want


def test_alerts_from_a_start_frame(spark):
    s = scores(spark, [0.9] * 10).withColumn("clip_start_frame", F.lit(432))
    assert alert_list(events.alerts(s)) == [441]


def intervals(spark, *pairs):
    return spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(pairs)], "clip_id long, ord long, start_frame long, end_frame long")


def found(spark, *alerts):
    return spark.createDataFrame([(1, a) for a in alerts], "clip_id long, alert long")


@pytest.mark.parametrize(
    "alerts, pairs, tolerance, delays, false",
    [
        ((47, 58, 71), ((40, 75),), 0, [7], []), ((3, 31), ((12, 27),), 0, [], [3, 31]), ((9,), ((12, 27),), 4, [-3], []),
        ((14, 52, 33), ((11, 20), (50, 60)), 0, [2, 3], [33]), ((4, 13, 30), ((0, 4), (4, 13), (13, 30)), 0, [4, 9, 17], []),
    ],
)
def test_matching(spark, alerts, pairs, tolerance, delays, false):
    a, e = found(spark, *alerts), intervals(spark, *pairs)
    assert sorted(r.delay for r in events.match(a, e, tolerance).collect()) == delays
    assert alert_list(events.false_alarms(a, e, tolerance)) == false


def test_false_alarms_per_hour_and_missing_fps(spark):
    clips = spark.createDataFrame([(1, "a", 30.0, 30)], "clip_id long, dataset string, fps double, total_frames long")
    a, e = found(spark, 25, 28, 4), intervals(spark, (0, 5))
    got = {r.name: r for r in events.metric_rows(events.clip_counts(clips, a, e)).collect()}
    assert len(got) == 13 and got["false_alarms_per_hour"].value == pytest.approx(7200)
    got = {r.name: r for r in events.metric_rows(events.clip_counts(clips.withColumn("fps", F.lit(None).cast("double")), a, e)).collect()}
    assert got["false_alarms_per_hour"].value is None and got["detection_delay_mean_seconds"].na_reason == "no fps / temporal metadata"


SCORED = [("p", 1, 0.95), ("q", 1, 0.55), ("r", 1, 0.35), ("s", 0, 0.75), ("t", 0, 0.55), ("u", 0, 0.15), ("v", 0, 0.05)]


def test_classification_by_hand(spark):
    p = spark.createDataFrame(SCORED, "clip_id string, y int, score double").withColumn("tags", F.create_map(F.lit("y"), F.col("y").cast("string")))
    m = clf.metrics(clf.by_slice(p))
    whole = m.where("tag is null").first()
    assert (whole.tp, whole.fn, whole.tn, whole.fp) == (2, 1, 2, 2)
    assert whole.accuracy == pytest.approx(4 / 7) and whole.f1 == pytest.approx(4 / 7) and whole.specificity == pytest.approx(0.5)
    assert whole.auc_roc == pytest.approx(8.5 / 12) and whole.auprc == pytest.approx(0.7)
    rows = {(r.tag_value, r.name): r for r in clf.metric_rows(m).collect()}
    assert len(rows) == 3 * 14
    assert rows["0", "recall"].na_reason == "no actual positives in slice" and rows["1", "auc_roc"].na_reason == "only one class present in slice"


def test_pairing_errors(spark):
    p = spark.createDataFrame([("a",), ("a",), ("b",)], "clip_id string")
    y = spark.createDataFrame([("a",), ("c",)], "clip_id string")
    got = sorted(tuple(r) for r in clf.pairing_errors(p, y).collect())
    assert got == [("duplicate_prediction", "a"), ("unlabeled_prediction", "b"), ("unpredicted_label", "c")]


def boxes(spark, frames, w=40.0, h=50.0):
    rows = [(1, 1, f, i, 0.0, 0.0, w, h, 1.0) for i, f in enumerate(frames)]
    return spark.createDataFrame(rows, "clip_id long, track_id long, frame_index long, ord long, x_min double, y_min double, x_max double, y_max double, confidence double")


@pytest.mark.parametrize(
    "frames, size, want",
    [(range(5), (40, 50), ["too_many_gaps"]), (range(30), (40, 50), [None]), (range(60), (8, 8), ["insufficient_coverage"] * 2), (list(reversed(range(64))), (40, 50), [None, None])],
)
def test_windows(spark, frames, size, want):
    got = windows.candidates(boxes(spark, frames, *map(float, size))).orderBy("candidate").collect()
    assert [r.reason for r in got] == want
    if want == [None]:
        assert got[0].missing_offsets == [30, 31] and got[0].coverage == pytest.approx(30 / 32)


def test_windows_against_a_loop(spark):
    rng = random.Random(5)
    for _ in range(3):
        frames = sorted(rng.sample(range(120), rng.randint(20, 110)))
        got = [(r.start_frame, r.reason) for r in windows.candidates(boxes(spark, frames), length=16, stride=8, gap_tolerance=2, max_windows=3).orderBy("candidate").collect()]
        want, done, start = [], 0, frames[0]
        while start <= frames[-1] and done < 3:
            run = longest = 0
            for f in range(start, start + 16):
                run = 0 if f in frames else run + 1
                longest = max(longest, run)
            want.append((start, "too_many_gaps" if longest > 2 else None))
            done += want[-1][1] is None
            start += 8
        assert got == want


def test_carry_forward_starts_anew_in_each_window(spark):
    b = boxes(spark, [f for f in range(64) if f not in (32, 33, 40)])
    got = {(r.window_index, r.frame_offset): r for r in windows.dense_boxes(b, windows.candidates(b)).collect()}
    assert got[1, 0].x_max == 0.0 and got[1, 0].missing_frame and got[1, 8].x_max == 40.0


def test_segments_switches_and_dominant(spark):
    rows = [(1, f, f, t) for f, t in ((0, 1), (1, None), (2, 2))]
    d = spark.createDataFrame(rows, "clip_id long, ord long, frame_index long, track_id long")
    t = tracks.dominant_tracks(d)
    assert [r.dominant for r in t.orderBy("frame_index").collect()] == [1, None, 2]
    assert tracks.switches(t).first().switches == 1
    seg = spark.createDataFrame([(1, i, f, 1, 0.5) for i, f in enumerate((3, 1, 2))], "clip_id long, ord long, frame_index long, track_id long, confidence double")
    assert [(r.start, r.end) for r in tracks.segments(seg).orderBy("segment").collect()] == [(3, 3), (1, 2)]
    assert tracks.track_summaries(seg).first().frame_indices == [3, 1, 2]


def test_geometry(spark):
    c = [F.lit(v) for v in (0.0, 24.0, 8.0, 40.0)]
    g = spark.range(1).select(scalars.crop_geometry(*c, 0.0, 64, 64).alias("g")).first().g
    assert (g.x_min, g.y_min, g.clipped_width, g.clipped_height, g.size, g.offset_x, g.offset_y) == (0, 24, 12, 16, 16, 2, 0)


@pytest.mark.parametrize(
    "name, want",
    [("fall-01-cam0 (1)", ("fall-01-cam0", "fall", "01", "cam0")), ("ADL-07-cam1-rgb", ("adl-07-cam1-rgb", "no_fall", "07", "cam1")), ("walk-1", None), ("", None), (None, None)],
)
def test_folder_names(spark, name, want):
    got = spark.createDataFrame([(name,)], "n string").select(scalars.clip_folder(F.col("n")).alias("f")).first().f
    assert (tuple(got) if got else None) == want


def test_frame_order(spark):
    names = ["frame_0002.png", "still.png", "frame_0001.png", "notes.txt"]
    got = manifests.order_frames(spark.createDataFrame([("c", n) for n in names], "folder string, name string")).orderBy("frame_index").collect()
    assert [(r.name, r.source_index) for r in got] == [("frame_0001.png", 1), ("frame_0002.png", 2), ("still.png", -1)]


@pytest.mark.parametrize(
    "text, event, errors",
    [
        ("0\n0\n1,1,204,61,273,198\n10,1,0,0,0,0\n", (None, None, None), [None, None]), ("5\n9\n", (5, 9, None), []), ("9\n5\n", (None, None, "inverted"), []),
        ("0\n5\n", (None, None, "one bound is zero"), []), ("3\n", (None, None, "too few lines"), []), ("0\n0\n1,1,9,1,5,2\n0,1,1,1,2,2\n1,2\nx,1,1,1,2,2", (None, None, None), ["box", "frame", "columns", "not an integer"]),
    ],
)
def test_annotations(spark, text, event, errors):
    e, d = manifests.parse_annotation(F.col("t"))
    got = spark.createDataFrame([(text,)], "t string").select(e.alias("e"), d.alias("d")).first()
    assert tuple(got.e) == event and [x.error for x in got.d] == errors
    if text.startswith("0\n0\n1,1,204"):
        assert [x.present for x in got.d] == [True, False]


def test_long_annotations_are_not_cut(spark):
    n = (1 << 20) + 5
    text = F.concat(F.lit("0\n0\n"), F.repeat(F.lit("1,1,0,0,0,0\n"), n))
    assert spark.range(1).select(text.alias("t")).select(F.size(manifests.parse_annotation(F.col("t"))[1]).alias("n")).first().n == n


def test_label_lines(spark, tmp_path):
    (tmp_path / "l.csv").write_text("fall-01,1,-1\nfall-01,2,0\nfall-01,2,1\nx\n,3,0\nfall-01,z,0\nfall-01,0,0\nfall-01,4,7\n\n")
    lines = manifests.read_label_lines(spark, str(tmp_path))
    assert sorted(r.error for r in labels.rejects(lines).collect()) == ["columns", "duplicate", "frame", "label", "not an integer", "sequence"]
    stats = labels.series_stats(manifests.frame_labels(lines).dropDuplicates(["sequence", "frame_number"])).first()
    assert (stats.frame_count, stats.contiguous) == (2, True)


def test_window_labels(spark):
    f = spark.createDataFrame([("fall-01", i, -1 if i < 83 else 0 if i < 113 else 1) for i in range(1, 161)], "sequence string, frame_number int, label int")
    w = spark.createDataFrame([("fall-01", "fall", 0, list(range(32))), ("fall-01", "fall", 1, [82]), ("fall-02", "fall", 0, [1]), ("adl-01", "adl", 0, [1])], "sequence string, clip_type string, window_index int, frame_indices array<int>")
    got = {(r.sequence, r.window_index): (r.label, r.is_confuser) for r in labels.label_windows(w, f, offset=1).collect()}
    assert got == {("fall-01", 0): ("no_fall", False), ("fall-01", 1): ("fall", False), ("fall-02", 0): ("unlabeled", False), ("adl-01", 0): ("no_fall", False)}
    got = labels.label_windows(w, f, offset=1, rule=labels.falling_only_rule).where("window_index = 1").first()
    assert got.label == "no_fall"


CLIP = "clip_id string, dataset string, role string, label string, source_path string, subject_id string, lighting string, occlusion string, action_confuser string, pos int"


def test_manifest_checks(spark):
    rows = [
        ("a", "urfd", "train", "fall", "p1", "s1", "dim", None, None, 0), ("b", "urfd", "validate", "fall", "p1", "s1", "neon", None, None, 1), ("b", "mcfd", "train", "x", "p2", None, None, None, None, 2),
        ("c", "new", "debug", "fall", "", None, None, None, None, 3), ("d", "le2i", "debug", "no_fall", "p4", None, None, None, None, 4),
    ]
    got = {(r.rule, r.key) for r in manifest.validate(spark.createDataFrame(rows, CLIP)).collect()}
    assert {("source_path_leak", "p1"), ("subject_leak", "s1"), ("duplicate_clip_id", "b"), ("train_validate", "b"), ("vault", "b"), ("label", "b"), ("unknown_dataset", "c"), ("required_fields", "c"), ("slice_lighting", "b"), ("cross_listed", "gmdcsa24")} == got
    frozen = spark.createDataFrame([("z", "mcfd", "frozen_unseen_test", "fall", "p", None, None, None, None, 0)], CLIP)
    assert manifest.visible(frozen, None).isEmpty() and manifest.visible(frozen, "final_judgement").count() == 1
    with pytest.raises(manifest.FrozenAccessError):
        manifest.frozen_only(frozen, "training")
    with pytest.raises(Exception, match="frozen clip"):
        manifest.assert_no_frozen(frozen, "tuning").collect()


def test_na_round_trip(spark):
    d = spark.createDataFrame([(1.5, None, "a"), (None, "why", "b")], "value double, na_reason string, name string")
    got = d.select(na.decode(na.encode(F.col("value"), F.col("na_reason"), F.col("name"))).alias("x")).collect()
    assert [tuple(r.x) for r in got] == [(1.5, None), (None, "why")]
    bad = spark.createDataFrame([("true",), ("{}",), (None,)], "j string").select(na.decode(F.col("j")).alias("x")).collect()
    assert [tuple(r.x) for r in bad] == [(None, None)] * 3


def test_store(spark, tmp_path):
    m = spark.createDataFrame([("a", 1.0, None), ("b", None, "why")], "name string, value double, na_reason string").withColumn("higher_is_better", F.lit(True))
    store.save_run(m, str(tmp_path), "r1", "m1")
    assert store.load_run(spark, str(tmp_path), "r1").count() == 2
    with pytest.raises(Exception):
        store.save_run(m, str(tmp_path), "r1", "m1")
    with pytest.raises(ValueError):
        store.run_path(str(tmp_path), "../x")
    with pytest.raises(Exception, match="malformed"):
        store.save_run(m.withColumn("na_reason", F.lit("x")), str(tmp_path), "r2", "m1")
    assert store.payload(m).first().summary == "metrics=1/2"


def test_shards_round_trip(spark, tmp_path):
    side = '{"clip_id":"c","dataset":"d","label":"fall","source_path":"p","track_id":7,"frame_index":%d,"frame_offset":%d}'
    rows = [(0, "c_t7_w000", i, bytes([i]), side % (i, i)) for i in range(3)] + [(0, "c_t70_w000", 0, b"x", "{}")]
    packed = shards.write_shards(spark.createDataFrame(rows, "shard_index long, clip_key string, frame_offset int, data binary, sidecar string"), str(tmp_path))
    assert packed.first().shard == "shard-0000.tar"
    got = shards.read_shards(spark, str(tmp_path))
    assert got.count() == 4 and examples.window_members(got, "c_t7_w000").count() == 3
    assert sorted(r.clip_key for r in shards.clip_keys(spark, str(tmp_path)).collect()) == ["c_t70_w000", "c_t7_w000"]
    assert shards.missing_keys(got).count() == 1 and shards.missing_sidecars(got).isEmpty()


def test_offsets_and_assembly(spark):
    rows = [("ok", o) for o in range(4)] + [("dup", 0), ("dup", 0)] + [("few", 0), ("few", 2)] + [("many", o) for o in range(5)] + [("off", o) for o in range(1, 5)]
    m = spark.createDataFrame(rows, "window_key string, frame_offset int")
    got = {r.window_key: (r.error, r.missing) for r in examples.offset_errors(m, "window_key", "frame_offset", F.lit(4)).collect()}
    assert got == {"dup": ("duplicate", [1, 2, 3]), "few": ("missing", [1, 3]), "many": ("length", []), "off": ("sequence", [0])}
    one = m.where("window_key = 'ok'").withColumns({"frame_index": F.col("frame_offset") * 10, "missing_frame": F.col("frame_offset") == 2, "coverage": F.lit(0.5)})
    a = examples.assemble(one).first()
    assert a.frame_indices == [0, 10, 20, 30] and a.n_missing == 1 and a.coverage == 0.5


def test_subsample_and_names(spark):
    d = spark.range(1).select(F.array(*map(F.lit, range(32))).alias("a"))
    assert d.select(scalars.subsample(F.col("a"), 16).alias("x")).first().x == list(range(0, 32, 2))
    assert d.select(scalars.subsample(F.col("a"), 5).alias("x")).first().x == [0, 8, 16, 23, 31]  # half to even: 7.75, 15.5, 23.25
    got = d.select(scalars.shard_name(F.lit(12345), F.lit(4)), scalars.safe_name(F.lit("a b/c")), scalars.safe_name(F.lit("")), scalars.box_label(F.lit(7), F.lit(0.829))).first()
    assert tuple(got) == ("shard-12345.tar", "a_b_c", "unnamed", "track 7 0.83")
    assert tuple(d.select(scalars.track_colour(F.lit(0)).alias("c")).first().c) == (242, 36, 36)


def test_selftest_needs_a_signal(spark):
    rows = selftest.synthetic(spark)
    assert selftest.run(rows).first().passed
    assert not selftest.run(rows.withColumn("score", F.lit(0.99))).first().passed


def test_manifest_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"schema_version": "1.1", "clips": [{"clip_id": "a", "role": "train"}, {"clip_id": "b", "other": 1}]}')
    m = manifests.read_manifest(spark, str(tmp_path / "m.json"))
    assert [(r.clip_id, r.pos) for r in m.orderBy("pos").collect()] == [("a", 0), ("b", 1)]
    (tmp_path / "n.json").write_text(manifests.manifest_json(m).first().value)
    assert manifests.read_manifest(spark, str(tmp_path / "n.json")).count() == 2
    assert manifests.expected_archives(spark, "https://example.org/x").count() == 70
