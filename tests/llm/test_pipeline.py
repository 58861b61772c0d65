"""The corpus pipeline: each stage against a plain version of its decision."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelore.llm import queries, simhash
from framelore.llm.common import save

from .test_operators import best_windows, components


@pytest.fixture(scope="module")
def stages(spark, data):
    """Each stage's input and output, written and read again."""
    d = data.replace("sf0.001", "sf0.01")
    docs, out = save(queries.table(spark, d, "documents"), "in"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, docs := save(stage(spark, docs, d), "stage"))
    return out


def test_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name


def test_quality_keeps_clean_documents(spark, data, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/labels.parquet").where(queries.remainder("doc_id", 3) == 1)
    kept = labels.join(after, "doc_id", "left_semi").groupBy("quality").count().collect()
    kept, all_ = {r.quality: r["count"] for r in kept}, {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    assert kept[1] >= 0.97 * all_[1] and kept.get(0, 0) <= 0.3 * all_[0] and after.count() < before.count()


def test_lines(stages):
    before, after = stages["lines"]
    both = before.select("doc_id", F.col("text").alias("a")).join(after, "doc_id")
    assert both.count() == before.count() and both.where("length(text) > length(a)").count() == 0
    assert both.where("n_chars <> char_length(text) and text <> a").count() == 0


def test_near_duplicates(stages):
    """One document of each group stays; of the pairs in each band of similarity nearly all are found, and no other is."""
    before, after = stages["near duplicates"]
    sets = {r.doc_id: set(simhash.shingle_hashes(simhash.words_of(r.text), 5).tolist()) for r in before.select("doc_id", "text").collect()}
    by_shingle = {}
    for d, s in sets.items():
        for h in s:
            by_shingle.setdefault(h, []).append(d)
    near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in {(a, b) for v in by_shingle.values() for a in v for b in v if a < b}}
    near = {p: s for p, s in near.items() if s >= 0.8}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_ids(before).collect()}
    for low, high, least in ((0.8, 0.85, 0.9), (0.85, 0.9, 0.97), (0.9, 1.1, 0.99)):
        band = [p for p, s in near.items() if low <= s < high]
        assert sum(got[a] == got[b] for a, b in band) >= least * len(band)
    true = components(list(sets), near)
    empty = min((d for d, s in sets.items() if not s), default=None)
    assert all(true[d] == true[c] or not sets[d] and c == empty for d, c in got.items())
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    assert len(kept) == after.count() and kept == set(got.values())


def test_benchmark(spark, data, stages):
    before, after = stages["benchmark"]
    items = [tuple(r) for r in spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/benchmark.parquet").select("item_id", "text").collect()]
    known = {tuple(w[k : k + 5]) for _, t in items for w in [simhash.words_of(t)] for k in range(len(w) - 4)}
    docs = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    maybe = [(d, t) for d, t in docs for w in [simhash.words_of(t)] if any(tuple(w[k : k + 5]) in known for k in range(len(w) - 4))]
    bad = {d for d, _ in best_windows([(d, t) for d, t in maybe], items)}
    assert {r.doc_id for r in after.collect()} == {d for d, _ in docs} - bad and bad


def test_mix(stages):
    before, after = stages["mixing"]
    assert after.count() == before.count() and after.where("taken > 3 * size").count() == 0


def test_run(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and got.count() > 100 and 4 <= len(corpus_pipeline.STAGES) <= 5
