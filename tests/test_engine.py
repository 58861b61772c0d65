"""Sweeps, scans, quantiles, contracts, rules, streams and the run store against plain versions of them."""

import bisect
import random
import threading

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framelore.operators import classification as clf
from framelore.operators import events, labels, manifest, quantiles, tensors
from framelore.sources import store

EVENT, ALERT = "clip_id long, ord long, start_frame long, end_frame long", "clip_id long, alert long"


# --- matching ----------------------------------------------------------------------------------------------------------


def outcomes(alerts, windows, tolerance):
    """One clip, plainly: windows are (ord, start, end)."""
    taken, out = {}, []
    for a in sorted(set(alerts)):
        holds = sorted(w for w in windows if w[1] - tolerance <= a <= w[2] + tolerance)
        free = [w for w in holds if w not in taken]
        if free:
            taken[free[0]] = a
            out.append((a, free[0][0], free[0][1], "matched"))
        else:
            out.append((a, None, None, "redundant" if holds else "false_alarm"))
    return out + [(None, w[0], w[1], "missed") for w in windows if w not in taken]


def plain_key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("seed, tolerance", [(0, 0), (1, 0), (2, 3), (3, 40)])
def test_matching_against_a_plain_version(spark, seed, tolerance):
    rng = random.Random(seed)
    alerts, windows = {}, {}
    for c in range(25):
        span = rng.choice([60, 600, 6000])
        alerts[c] = [rng.randrange(span) for _ in range(rng.randrange(30))]
        order = rng.sample(range(100), rng.randrange(12))
        windows[c] = [(o, s, s + rng.randrange(rng.choice([4, 80]))) for o, s in ((o, rng.randrange(span)) for o in order)]
    a = spark.createDataFrame([(c, x) for c in alerts for x in alerts[c]] + [(None, 3), (99, None)], ALERT)
    e = spark.createDataFrame([(c, *w) for c in windows for w in windows[c]] + [(None, 1, 2, 3)], EVENT)
    got = sorted((tuple(r) for r in events.matching(a, e, tolerance).collect()), key=plain_key)
    assert got == sorted(((c, *o) for c in alerts for o in outcomes(alerts[c], windows[c], tolerance)), key=plain_key)


def test_windows_without_bounds_and_inverted_ones_hold_nothing(spark):
    e = spark.createDataFrame([(1, 0, None, 9), (1, 1, 4, None), (1, 2, 8, 5), (1, 3, 2, 6)], EVENT)
    got = sorted((tuple(r)[1:] for r in events.matching(spark.createDataFrame([(1, 5), (1, 6), (1, 7)], ALERT), e).collect()), key=plain_key)
    want = [(5, 3, 2, "matched"), (6, None, None, "redundant"), (7, None, None, "false_alarm"), (None, 0, None, "missed"), (None, 1, 4, "missed"), (None, 2, 8, "missed")]
    assert sorted(got, key=plain_key) == sorted(want, key=plain_key)
    none = spark.createDataFrame([], EVENT)
    assert [r.outcome for r in events.matching(spark.createDataFrame([(1, 5)], ALERT), none).collect()] == ["false_alarm"]
    assert events.matching(spark.createDataFrame([], ALERT), none).count() == 0


def test_a_clip_of_very_many_alerts(spark):
    n = 300_000
    a = spark.range(n).select(F.lit(1).cast("long").alias("clip_id"), F.col("id").alias("alert"))
    e = spark.range(n // 100).select(F.lit(1).cast("long").alias("clip_id"), F.col("id").alias("ord"), (F.col("id") * 100).alias("start_frame"), (F.col("id") * 100 + 150).alias("end_frame"))
    got = {r.outcome: r["count"] for r in events.matching(a, e).groupBy("outcome").count().collect()}
    assert got == {"matched": n // 100, "redundant": n - n // 100}


# --- alerts ------------------------------------------------------------------------------------------------------------


def plain_alerts(rows, threshold, persistence):
    out, run = [], 0
    for pos, score in sorted(rows):
        run = run + 1 if score is not None and score >= threshold else 0
        out += [pos] if run and run % persistence == 0 else []
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 16])
def test_alerts_do_not_depend_on_blocks(spark, block):
    rng = random.Random(block)
    rows = []
    for c in range(8):
        pos = sorted(rng.sample(range(-40, 160), 90))
        hit = rng.choice([0.6, 0.9, 1.0])
        rows += [(c, p, None if rng.random() < 0.02 else float("nan") if rng.random() < 0.02 else 0.9 if rng.random() < hit else 0.1) for p in pos]
    got = events.alerts(spark.createDataFrame(rows + [(1, None, 0.9)], "clip_id long, pos long, score double"), 0.5, 4, block)
    want = [(c, p) for c in range(8) for p in plain_alerts([(p, s if s is not None and s == s else None) for k, p, s in rows if k == c], 0.5, 4)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_one_long_clip_spreads_over_tasks(spark):
    s = spark.range(400_000).select((F.col("id") % 1).alias("clip_id"), F.col("id").alias("pos"), F.when(F.col("id") % 1000 == 999, 0.0).otherwise(0.9).alias("score"))
    found = events.alerts(s, 0.5, 10, 4096)
    assert found.count() == 400 * 99
    text = found._jdf.queryExecution().toString()
    assert "hashpartitioning(clip_id" in text and "block" in text
    windows = [line for line in text.split("== Physical Plan ==")[1].splitlines() if "Window [" in line and "row_number" in line]
    assert windows and all("block" in w.split("row_number")[1] for w in windows)


# --- streams -----------------------------------------------------------------------------------------------------------

SCORE = "clip_id long, pos long, score double, ts timestamp, clip_start_frame long"


def run_stream(query, tmp_path, name):
    q = query.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp"))
    q.trigger(availableNow=True).start().awaitTermination(120)


def test_streaming_alerts_out_of_order_equal_batch_and_state_goes(spark, tmp_path):
    from framelore.streaming.alerts import streaming_alerts

    rng = random.Random(4)
    rows = [(c, i, rng.choice([0.1, 0.9, 0.9, 0.9]), 1_700_000_000 + i, 100 * c) for c in range(3) for i in range(60) if (c, i) != (2, 31)]  # one frame never comes
    mixed = sorted(rows, key=lambda r: r[1] // 20 * 20 + rng.randrange(30))
    mixed.append(mixed[5])
    make = lambda part: spark.createDataFrame([(c, i, s, float(t), b) for c, i, s, t, b in part], "clip_id long, pos long, score double, t double, clip_start_frame long").select("clip_id", "pos", "score", F.timestamp_seconds("t").alias("ts"), "clip_start_frame")
    (tmp_path / "in").mkdir()
    stream = streaming_alerts(spark.readStream.schema(SCORE).parquet(str(tmp_path / "in")).withWatermark("ts", "2 minutes"), 0.8, 3, timeout="10 minutes")
    for k in range(0, len(mixed), 60):
        make(mixed[k : k + 60]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_stream(stream, tmp_path, "out")
    later = [(77, 0, 0.1, 1_700_100_000, 0)], [(77, 1, 0.1, 1_700_100_001, 0)]
    for part in later:  # the watermark goes past the clips' end
        make(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_stream(stream, tmp_path, "out")
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in events.alerts(make(rows), 0.8, 3).collect())
    assert got == want and any(a >= 200 + 31 for c, a in got if c == 2)
    state = spark.read.format("statestore").option("stateVarName", "progress").load(str(tmp_path / "out-cp"))
    assert [r.key.clip_id for r in state.select("key").collect()] == [77]


def test_streaming_matches_equal_a_range_join(spark, tmp_path):
    from framelore.streaming.alerts import streaming_matches

    at = lambda x: F.timestamp_seconds(F.lit(1_700_000_000) + x)
    alerts = spark.range(30).select(F.col("id") % 3, at(F.col("id") * 7)).toDF("clip_id", "alert_ts")
    windows = spark.range(20).select(F.col("id") % 3, F.col("id"), at(F.col("id") * 11), at(F.col("id") * 11 + 9)).toDF("clip_id", "ord", "start_ts", "end_ts")
    alerts.write.parquet(str(tmp_path / "a"))
    windows.write.parquet(str(tmp_path / "e"))
    read = lambda name, like, ts: spark.readStream.schema(like.schema).parquet(str(tmp_path / name)).withWatermark(ts, "5 seconds")
    run_stream(streaming_matches(read("a", alerts, "alert_ts"), read("e", windows, "start_ts"), "2 seconds", "1 minute"), tmp_path, "m")
    got = sorted((r.clip_id, r.ord, r.alert_ts) for r in spark.read.parquet(str(tmp_path / "m")).collect())
    a, e = alerts.collect(), windows.collect()
    slack = __import__("datetime").timedelta(seconds=2)
    assert got == sorted((x.clip_id, w.ord, x.alert_ts) for x in a for w in e if x.clip_id == w.clip_id and w.start_ts - slack <= x.alert_ts <= w.end_ts + slack)
    assert len(got) > 10


def test_daily_counts(spark, tmp_path):
    from framelore.streaming.alerts import daily_counts

    day = lambda d, h: F.timestamp_seconds(F.lit(1_700_006_400 + 86_400 * d + 3600 * h))
    rows = spark.range(1).select(F.explode(F.array(*(F.struct(day(d, h).alias("ts"), F.lit(t).alias("event_type"), F.lit(v).alias("value")) for d, h, t, v in [(0, 1, "a", 1.0), (0, 2, "a", 2.0), (0, 3, "b", 5.0), (1, 1, "a", 7.0)])))).select("col.*")
    rows.write.parquet(str(tmp_path / "in"))
    late = spark.range(1).select(day(9, 0).alias("ts"), F.lit("z").alias("event_type"), F.lit(0.0).alias("value"))
    stream = daily_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    run_stream(stream, tmp_path, "out")
    for _ in range(2):
        late.write.mode("append").parquet(str(tmp_path / "in"))
        run_stream(stream, tmp_path, "out")
    got = sorted((r.window.start.day, r.event_type, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).where("event_type <> 'z'").collect())
    assert got == [(15, "a", 2, 3.0), (15, "b", 1, 5.0), (16, "a", 1, 7.0)]


# --- quantiles and ranks -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_percentiles_are_exact(spark, ranges):
    rng = np.random.default_rng(ranges)
    values = {"a": rng.normal(0, 1e6, 500), "b": np.repeat([3.0, 3.0, 8.0], 70), "c": np.array([5.0]), None: rng.random(7) * 1e-9, "d": np.array([-np.inf, 1.0, np.inf])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("e", None), ("a", float("nan"))]
    d = spark.createDataFrame(rows, "k string, v double")
    ps = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.k: r for r in quantiles.exact_percentiles(d, "v", ps, ("k",), ranges).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert got[k].n == len(vs)
        if k != "d":
            assert [got[k][name] for name in ps] == pytest.approx([np.quantile(vs, p) for p in ps.values()], rel=1e-12)
    assert (got["d"].low, got["d"].mid, got["d"].top) == (-np.inf, 1.0, np.inf)
    every = np.concatenate([vs for k, vs in values.items() if k != "d"])
    whole = quantiles.exact_percentiles(d.where("k <> 'd' or k is null"), "v", ps, ranges=ranges).first()
    assert [whole[name] for name in ps] == pytest.approx([np.quantile(every, p) for p in ps.values()], rel=1e-12)
    none = quantiles.exact_percentiles(d.limit(0), "v", ps).first()
    assert none.n == 0 and none.mid is None and quantiles.exact_percentiles(d.limit(0), "v", ps, ("k",)).count() == 0


def test_ranges_find_their_values(spark):
    cuts = [float(x) for x in range(0, 300, 3)]
    d = spark.range(-5, 320).select((F.col("id") / 1.0).alias("v")).withColumn("r", quantiles.range_of(F.col("v"), cuts))
    assert all(r.r == bisect.bisect_left(cuts, r.v) for r in d.collect())


@pytest.mark.parametrize("scale, shift", [(1, 0), (40, -20), (1e-7, 0.5)])
def test_ranking_on_scores_of_any_scale(spark, scale, shift):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.normal(y * 0.7, 1.0), 1) * scale + shift
    d = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))] + [(1000, None, 1)], "clip_id long, score double, y int")
    got = clf.ranking(clf.by_slice(d.withColumn("tags", F.create_map().cast("map<string,string>"))), 16).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap = sum((pos == t).sum() / len(pos) * (pos >= t).sum() / (s >= t).sum() for t in np.unique(s))
    assert got.auc_roc == pytest.approx(auc) and got.auprc == pytest.approx(ap)


# --- pairing, manifests, rules -----------------------------------------------------------------------------------------


def test_pairing_is_checked_and_merges_tags(spark):
    tags = "clip_id string, {} , tags map<string,string>"
    p = spark.createDataFrame([("a", 0.9, {"x": "1", "y": "p"}), ("b", 0.1, None)], tags.format("score double"))
    t = spark.createDataFrame([("b", 0, {"y": "l"}), ("a", 1, {"y": "l", "z": "2"})], tags.format("y int"))
    got = {r.clip_id: (r.score, r.y, r.tags) for r in clf.pair(p, t).collect()}
    assert got == {"a": (0.9, 1, {"x": "1", "y": "p", "z": "2"}), "b": (0.1, 0, {"y": "l"})}
    for bad, message in ((p.unionAll(p.limit(1)), "duplicate prediction: a"), (p.where("clip_id = 'b'"), "unpredicted label: a")):
        with pytest.raises(PySparkException, match=message):
            clf.pair(bad, t).collect()
    for bad, message in ((t.unionAll(t.where("clip_id = 'b'")), "duplicate label: b"), (t.where("clip_id = 'b'"), "unlabeled prediction: a"), (t.withColumn("y", F.lit(2)), "label: ")):
        with pytest.raises(PySparkException, match=message):
            clf.pair(p, bad).collect()
    with pytest.raises(PySparkException, match="no clip id: null"):
        clf.pair(p.withColumn("clip_id", F.nullif("clip_id", F.lit("a"))), t.withColumn("clip_id", F.nullif("clip_id", F.lit("a")))).collect()
    assert clf.pair(p.limit(0), t.limit(0)).count() == 0


CLIP = "pos long, clip_id string, dataset string, role string, label string, source_path string, subject_id string, lighting string, occlusion string, action_confuser string"


def test_every_manifest_rule_in_two_passes(spark):
    good = ("urfd", "train", "fall", None, "dim", "none", "none")
    rows = [
        (0, "a", "urfd", "train", "fall", "p0", "s1", "dim", None, None), (1, "b", "urfd", "validate", "fall", "p0", "s1", "dark", "some", "running"), (2, "a", "le2i", "validate", "no_fall", "p2", None, None, None, None),
        (3, "c", "omnifall", "train", "fall", "p3", None, None, None, None), (4, "d", "other", "debug", "maybe", "p4", None, None, None, None), (5, "e", "other", "boss", "fall", "p5", None, None, None, None),
        (6, None, None, "debug", "fall", " ", None, None, None, None), (7, "g", "gmdcsa24", "debug", "fall", "p7", None, None, None, None),
    ]
    m = spark.createDataFrame(rows, CLIP)
    got = sorted((r.severity, r.rule, r.key, r.detail) for r in manifest.validate(m, "9").collect() if r.key is not None)
    assert got == [
        ("error", "duplicate_clip_id", "a", "2"), ("error", "label", "d", "maybe"), ("error", "role", "e", "boss"), ("error", "source_path_leak", "p0", None), ("error", "subject_leak", "s1", None),
        ("error", "train_validate", "a", None), ("error", "vault", "c", "omnifall"), ("warning", "cross_listed", "le2i", None), ("warning", "slice_action_confuser", "b", "running"),
        ("warning", "slice_lighting", "b", "dark"), ("warning", "slice_occlusion", "b", "some"), ("warning", "unknown_dataset", "d", "other"),
    ]
    none = sorted((r.rule, r.detail) for r in manifest.validate(m, "9").collect() if r.key is None)
    assert none == [("dataset", None), ("required_fields", "clip_id,dataset,source_path"), ("schema_version", "9"), ("unknown_dataset", None)]
    assert sorted(r.key for r in manifest.validate(m.limit(0)).collect()) == ["gmdcsa24", "le2i"]
    assert len(good) == 7


def test_manifest_is_scanned_twice(spark, tmp_path):
    spark.createDataFrame([(0, "a", "urfd", "train", "fall", "p0", "s1", "dim", None, None)], CLIP).write.parquet(str(tmp_path / "m"))
    plan = manifest.validate(spark.read.parquet(str(tmp_path / "m")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2


def in_python(kind, label):
    known = label[~np.isnan(label)]
    if kind == "fall":
        return ("fall" if np.isin(known, (0, 1)).any() else "no_fall" if len(known) else "unlabeled"), False
    return "no_fall", bool((known == 1).any())


def test_a_rule_in_python_equals_the_built_in_one(spark):
    rng = random.Random(5)
    windows = spark.createDataFrame([(s, "fall" if s % 2 else "adl", w, [w * 3 + k for k in range(3)]) for s in range(20) for w in range(4)] + [(50, "fall", 0, [])], "sequence long, clip_type string, window_index int, frame_indices array<int>")
    series = spark.createDataFrame([(s, f, rng.choice([-1, -1, 0, 1])) for s in range(20) for f in range(12) if rng.random() < 0.6], "sequence long, frame_number int, label int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(labels.label_windows(windows, series))
    assert rows(labels.label_windows(windows, series, rule=labels.python_rule(in_python))) == want
    labels.register_rule(spark, "my_rule", in_python)
    spread = windows.select("sequence", "clip_type", "window_index", F.explode_outer("frame_indices").alias("frame_number"))
    sql = """select sequence, window_index, r.label, r.is_confuser from (select sequence, window_index,
      my_rule(first(clip_type), collect_list(coalesce(cast(label as double), double('NaN')))) r from {w} left join {s} using (sequence, frame_number) group by sequence, window_index)"""
    assert rows(spark.sql(sql, w=spread, s=series)) == want
    with pytest.raises(PySparkException, match="a rule gives one of"):
        labels.label_windows(windows, series, rule=labels.python_rule(lambda kind, label: ("maybe", False))).collect()
    with pytest.raises(ValueError):
        labels.register_rule(spark, "my rule", in_python)


# --- tensors -----------------------------------------------------------------------------------------------------------


def test_tensor_contracts(spark):
    good = np.linspace(-1, 2, 12, dtype="float32")
    rows = {"good": good, "short": good[:5], "raw": np.linspace(0, 1, 12, dtype="float32"), "nan": np.r_[good[:11], np.float32(np.nan)], "wide": good * 100, "empty": good[:0]}
    data = [(k, v.tobytes(), [float(x) for x in v]) for k, v in rows.items()] + [("null", None, None), ("odd", b"123", [1.0, None])]
    d = spark.createDataFrame(data, "k string, b binary, a array<float>")
    for column in ("b", "a"):
        m = tensors.tensor_moments(d, column, ("k",))
        got = sorted((r.k, r.error) for r in tensors.violations(m, (3, 4), -10, 10, (0.0, 1.0)).collect())
        assert got == [("empty", "shape"), ("nan", "non_finite"), ("null", "unreadable"), ("odd", "unreadable"), ("raw", "scale"), ("short", "scale"), ("short", "shape"), ("wide", "range")]
        whole = tensors.merged(m).first()
        values = np.concatenate(list(rows.values())).astype(float)
        fine = values[np.isfinite(values)]
        assert (whole.tensors, whole.n, whole.non_finite) == (6, len(values), 1)
        assert (whole.mean, whole["std"]) == pytest.approx((fine.mean(), fine.std())) and (whole.least, whole.most) == (fine.min(), fine.max())
    assert tensors.tensor_moments(d.limit(0), "b", ("k",)).count() == 0


# --- run store ---------------------------------------------------------------------------------------------------------


def metric_rows(spark, *values):
    return spark.createDataFrame([(f"m{i}", float(v), None) for i, v in enumerate(values)], "name string, value double, na_reason string").withColumn("higher_is_better", F.lit(True))


def test_runs_are_published_whole_and_keep_their_history(spark, tmp_path):
    root = str(tmp_path)
    store.save_run(metric_rows(spark, 1), root, "r", "m")
    with pytest.raises(store.RunConflict):
        store.save_run(metric_rows(spark, 2), root, "r", "m")
    open_before = store.load_run(spark, root, "r")
    store.save_run(metric_rows(spark, 2, 3), root, "r", "m", overwrite=True)
    value = lambda df: sorted(r.value for r in df.collect())
    assert value(open_before) == [1.0] and value(store.load_run(spark, root, "r")) == [2.0, 3.0]
    assert store.versions(spark, root, "r") == [1, 2] and value(store.load_run(spark, root, "r", 1)) == [1.0]
    bad = metric_rows(spark, 4).withColumn("value", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(PySparkException, match="broken"):
        store.save_run(bad, root, "r", "m", overwrite=True)
    assert value(store.load_run(spark, root, "r")) == [2.0, 3.0] and len(list((tmp_path / "run_id=r").glob("data-*"))) == 2
    with pytest.raises(FileNotFoundError):
        store.load_run(spark, root, "none")


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "versions", lambda *_: [])  # both have looked before either writes
    done = []

    def write(v):
        try:
            store.save_run(metric_rows(spark, v), str(tmp_path), "r", "m")
            done.append(v)
        except store.RunConflict:
            done.append(None)

    threads = [threading.Thread(target=write, args=(v,)) for v in (1, 2, 3)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    monkeypatch.undo()
    won = [v for v in done if v is not None]
    assert len(done) == 3 and len(won) == 1
    assert [r.value for r in store.load_run(spark, str(tmp_path), "r").collect()] == won
    assert len(list((tmp_path / "run_id=r").glob("data-*"))) == 1
