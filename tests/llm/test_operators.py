"""The training-data operators against brute force, round trips, held-out rows and hard inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from framelore.llm import chat, common, decontaminate, embeddings, html_extract, line_dedup, lm, mixing, quality, queries, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def prose(rng, n, words=None):
    words = words or [f"w{i}" for i in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names operators use themselves."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 60), "en", f"s{i % 3}", None) for i in range(12)]
    rows += [(12, None, None, None, None), (13, "", "en", "s0", 0), (14, " \n\t ", "en", None, 3), (None, "no id here", "en", "s1", 5), rows[0], rows[0]]
    rows += [(15, prose(rng, 60_000), "en", "s2", 1), (16, "%%% " * 50, "en", "s2", 1), (17, rows[1][1].upper(), "en", "s0", 1)]
    d = spark.createDataFrame(rows, DOCS)
    return d.withColumns({c: F.lit("x") for c in ("id", "t", "host", "key", "bucket", "size", "score", "n_lines", "component_id", "v", "__x")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- components --------------------------------------------------------------------------------------------------------


def test_a_task_contracts_its_edges_chunk_by_chunk(monkeypatch):
    monkeypatch.setattr(common, "CHUNK", 3)
    batches = [pd.DataFrame({"v": v, "p": p}, dtype="int64") for v, p in (([5, 6], [4, 5]), ([9], [8]), ([], []), ([7, 9], [6, 4]))]
    out = [[tuple(map(int, e)) for e in part.to_numpy()] for part in common._forest(iter(batches))]
    assert [sorted(x) for x in out] == [[(5, 4), (6, 4), (9, 8)], [(7, 6), (9, 4)]]
    assert list(common._forest(iter([]))) == []


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, x) for x in range(1001, 1100)] + [(2000 + i, 2001 + i) for i in range(40)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components({x for p in pairs for x in p}, pairs)
    assert got == {n: r for n, r in want.items() if any(n in p and p[0] != p[1] for p in pairs)}


# --- 1: HTML -----------------------------------------------------------------------------------------------------------

LONG = "The quick brown fox is in the garden of the old house and it was there for all of the day with the others."
PAGE = f"""<html><head><title>T</title><style>p{{}}</style><script>var x = "</p><p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, that is the way of the web and it is what it is for all of us.</div>
<article><h1>Head&amp;line</h1><p>{LONG}</p><p>Short one.</p><p>Caf&eacute;&nbsp;&#233; &lt;b&gt;<br>next   line</p><!-- <p>gone</p> --><blockquote>{LONG}</blockquote>
<div class="share-buttons">Share this with all of your friends and the people that you know in the world</div><form><p>{LONG}</p></form></article>
<aside><p>{LONG}</p></aside><section id="comments"><p>{LONG}</p></section><footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "\n\n".join(["Head&line", LONG, "Short one.", "Café é <b> next line", LONG])


@pytest.mark.parametrize("html, want", [(None, ""), ("", ""), ("<p>", ""), ("<article><p>a<p>b", "a\n\nb"), ("<script>x", ""), ("<article>a &amp b<!-- x", "a & b"), ("<<<>>>&&&", "")])
def test_broken_pages(html, want):
    assert html_extract.main_text(html) == want


def test_pages_without_an_article():
    page = f"<body><div class=menu><a href=1>a</a></div><div><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div><a href=x>{LONG}</a></div></body>"
    assert html_extract.main_text(page) == f"{LONG}\n\nYes.\n\n{LONG}"


def tree(rng, depth=0):
    """A random element: (tag, attributes, children), children being elements or texts."""
    inline = depth > 1 and rng.random() < 0.3
    tag = rng.choice(["b", "i", "span", "a"]) if inline else rng.choice(["div", "section", "p", "h2", "blockquote"] if depth else ["div", "article", "section", "nav", "footer"])
    attrs = rng.choice(["", "", "", "", ' class="ad"', ' style="display: none"', ' class="post-content"', ' id="sidebar"', ' href="x"'])
    children = []
    for _ in range(rng.randrange(1, 4)):
        if (rng.random() < 0.5 or depth > 3) and not (children and isinstance(children[-1], str)):
            n = rng.choice([2, 3, 8, 25])
            children.append(" ".join(rng.choice("the of and to in zorp quix blee tanno wub".split()) for _ in range(n)) + " ")
        elif tag not in ("p", "h2", "b", "i", "span", "a") and depth < 6:
            children.append(tree(rng, depth + 1))
        else:
            children.append((rng.choice(["b", "span"]), rng.choice(["", ' class="ad"']), [" ".join(rng.choice("of zorp".split()) for _ in range(rng.randrange(1, 9))) + " "]))
    return tag, attrs, children


def as_html(node):
    return node if isinstance(node, str) else f"<{node[0]}{node[1]}>{''.join(map(as_html, node[2]))}</{node[0]}>"


def plain_blocks(nodes):
    """Blocks of element trees by walking through them: what a node is in is passed down, boilerplate inline elements are left out."""
    out, now = [], []
    block = lambda t: t in html_extract.BLOCK

    def cut(stand, heading):
        text = " ".join("".join(t for t, _ in now).split())
        if text:
            out.append((text, sum(len(t.strip()) for t, link in now if link), stand, heading))
        now.clear()

    def walk(node, stand, heading, link):
        if isinstance(node, str):
            now.append((node, link))
            return
        tag, attrs, children = node
        named = {"class": "class", "id": "id", "style": "style", "href": "href"}
        attrs = {k: attrs.split('"')[1] for k in named if f" {k}=" in attrs}
        kind = html_extract._kind(tag, attrs, stand == 1)
        if not block(tag):
            if kind != -1:
                for c in children:
                    walk(c, stand, heading, link or tag == "a")
            return
        cut(stand, heading)
        inner = -1 if -1 in (kind, stand) else max(kind, stand)
        for c in children:
            walk(c, inner, heading or tag == "h2", False)
        cut(inner, heading or tag == "h2")

    for n in nodes:
        walk(n, 0, False, False)
    cut(0, False)
    return out


def plain_main_text(found, long=70, links=0.33, stops=0.12):
    density = lambda t: sum(w in html_extract.STOP for w in t.split()) / max(1, len(t.split()))
    if any(b[2] == 1 for b in found):
        found = [b for b in found if b[2] != 0]
    body = " ".join(b[0] for b in found if b[2] != -1 and len(b[0]) >= long)
    if density(body) < 0.02:
        stops = 0
    labels = []
    for text, linked, stand, heading in found:
        dense, short = linked > links * len(text), len(text) < long
        if stand == -1 or dense and (stand == 0 or short and not heading):
            labels.append(-1)
        elif short:
            labels.append(0)
        else:
            labels.append(1 if density(text) >= stops else -1 if stand == 0 and density(text) < stops / 3 else 0)
    kept = []
    for i, b in enumerate(found):
        ahead = [j for j in range(len(found)) if labels[j] and found[j][2] == b[2]]
        gap = min((abs(i - j) for j in ahead), default=None)
        after = next((j for j in ahead if j > i), None)
        if labels[i]:
            keep = labels[i] == 1
        elif b[3] and after is not None:
            keep = labels[after] == 1
        elif gap:
            keep = any(labels[j] == 1 for j in ahead if abs(i - j) == gap)
        else:
            keep = b[2] == 1
        if keep or not labels[i] and b[2] == 1 and 1 not in labels:
            kept.append(b[0])
    return "\n\n".join(kept)


def test_main_text_against_a_plain_version():
    rng, some = random.Random(11), 0
    for _ in range(1500):
        nodes = [tree(rng) for _ in range(rng.randrange(1, 6))]
        html = "<html><body>" + "".join(map(as_html, nodes)) + "</body></html>"
        want = plain_blocks(nodes)
        assert html_extract.blocks(html) == want, html
        assert html_extract.main_text(html) == plain_main_text(want), html
        some += bool(html_extract.main_text(html))
    assert some > 500


def test_inline_boilerplate_and_unclosed_tags():
    assert html_extract.main_text(f'<p>{LONG} <span class="ad">BUY NOW</span>and <i style="display:none">hidden</i>more</p>') == f"{LONG} and more"
    assert html_extract.main_text(f'<p>{LONG}<a class="share" href=x>y</p><p>{LONG}') == f"{LONG}y\n\n{LONG}"
    assert html_extract.main_text(f"<article><p>Hi <a href=x>{LONG}<p>{LONG}</article>") == f"Hi {LONG}\n\n{LONG}"
    assert html_extract.main_text(f'<p>{LONG}</p><span class="ad"><div>{LONG}</div></span>') == LONG
    assert html_extract.main_text(f"<p title='it is {LONG}>x'>{LONG}</p><p title=it's>{LONG}</p>") == f"{LONG}\n\n{LONG}"


@pytest.mark.parametrize("text", ["Быстрая коричневая лиса прыгает через ленивую собаку и бежит дальше по полю к своему дому, где её ждут.", "敏捷的棕色狐狸跳过了懒狗。" * 9])
def test_languages_without_known_stop_words(text):
    page = f"<div class=menu><a href=1>a</a></div><div><p>{text}</p><p>{text}</p></div><div><a href=x>{text}</a></div>"
    assert html_extract.main_text(page) == f"{text}\n\n{text}"


LONG_PAGES = [
    "<p>a b</p>", "<div>", "<a '", '<a b="x>" ', "<a x='>", "<li><ul><div></div></li>", "<span class=ad><p>x</p>", "<svg>", "<a href=x>text ", "<", "<p><span><ul><li>", "<!-- ", "</p>", "&amp",
]


@pytest.mark.parametrize("piece", LONG_PAGES)
def test_long_pages_take_time_by_their_length(piece):
    import time

    def seconds(n):
        began = time.process_time()
        html_extract.main_text(piece * (n // len(piece)) + "</li>" * 1000)
        return time.process_time() - began

    seconds(10_000)
    assert seconds(2_000_000) < 8


def test_deep_nesting_and_long_pages():
    assert html_extract.main_text("<div>" * 3000 + "<article>" + f"<p>{LONG}</p>" * 2000).count(LONG) == 2000


def test_extraction_keeps_columns(spark):
    d = spark.createDataFrame([(1, "u", PAGE, "n"), (None, None, None, None), (2**60, "u", "<article>é</article>", "n")], "page_id long, url string, html string, n_chars string")
    got = html_extract.extract_main_text(d).collect()
    assert [r.page_id for r in got] == [1, None, 2**60] and [r.n_chars for r in got][1:] == [0, 1] and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert html_extract.extract_main_text(d.limit(0)).count() == 0


# --- 2: SimHash --------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), seed=42) for i in range(max(1, len(words) - n + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, hard, data):
    d = hard.select("doc_id", "text").union(spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id") + 100, "text"))
    rows, got = d.collect(), simhash.simhash_components(d).collect()
    assert len(got) == len(rows)
    fps = {r.doc_id: plain_fingerprint(r.text, 4) for r in rows}
    ids = [i for i in fps if i is not None]
    v = np.array([fps[i] for i in ids], np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4, 1))
    want = components(ids, [(ids[i], ids[j]) for i, j in zip(a, b)])
    for r in got:
        assert int(r.fingerprint, 16) == fps[r.doc_id] and len(r.fingerprint) == 16
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]


def test_ball_pairs_find_everything_within_the_radius(spark):
    rng = random.Random(9)
    values = []
    for _ in range(60):
        x = rng.getrandbits(64)
        values.append(x)
        for flips in (1, 3, 4, 5):
            values.append(x ^ sum(1 << i for i in rng.sample(range(64), flips)))
    values = sorted(set(values))
    rows = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in values]
    d = spark.createDataFrame(rows, "id long").select("id", F.lit(0).alias("tbl"), F.col("id").alias("fp"))
    got = components(range(len(values)), [(i, j) for i, j in _index(simhash.ball_edges(d, len(rows)).collect(), rows)])
    v = np.array(values, np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4, 1))
    assert got == components(range(len(values)), zip(a.tolist(), b.tolist()))


def _index(pairs, rows):
    at = {r[0]: i for i, r in enumerate(rows)}
    return [(at[p.a], at[p.b]) for p in pairs]


def test_slices_of_a_ball_lose_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 20, 60, np.uint64)
    ids, left = np.arange(60), np.full(60, 2)
    whole = [tuple(np.concatenate(x)) for x in zip(*simhash.collisions(ids, fps, left, 20))]
    monkeypatch.setattr(simhash, "VARIANTS", 500)
    pairs = lambda groups: {frozenset(rows[group == g].tolist()) for rows, group in groups for g in np.unique(group)}
    parts = pairs(simhash.collisions(ids, fps, left, 20))
    assert parts == pairs([(np.array(whole[0]), np.array(whole[1]))])


def near_copies(rng, n_groups=12, size=5):
    rows, doc = [], 0
    for g in range(n_groups):
        base = prose(rng, 300, [f"g{rng.randrange(5000)}" for _ in range(500)]).split()
        for k in range(size):
            words = list(base)
            for _ in range(k):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
            rows.append((doc, " ".join(words)))
            doc += 1
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = near_copies(random.Random(2)) + [(500, None), (501, ""), (502, "a b"), (503, "A  b")]
    sets = {i: set(simhash.shingle_hashes(simhash.words_of(t), 5).tolist()) for i, t in rows}
    same = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = components(list(sets), [(a, b) for a in sets for b in sets if a < b and same(a, b)])
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicate_ids(d).collect()} == want


def test_listed_edges_name_every_pair_or_connect_it(spark):
    """Below four at a variant each pair is an edge, named once; dense edges connect the rest."""
    rng = random.Random(10)
    values = set()
    for k in range(120):
        x = rng.getrandbits(40)
        for _ in range(rng.choice([1, 2, 2, 3, 9])):
            values.add(x ^ sum(1 << i for i in rng.sample(range(40), rng.randrange(3))))
    values = sorted(values)
    d = spark.createDataFrame([(0, v, 7 * i) for i, v in enumerate(values)], "tbl int, fp long, id long").withColumn("several", F.lit(False))
    met = simhash.ball_edges(d, len(values), 40, 1, 4, True).collect()
    sparse, dense = {(e.a // 7, e.b // 7) for e in met if not e.dense}, [(e.a // 7, e.b // 7) for e in met if e.dense]
    v = np.array(values, np.uint64)
    near = set(zip(*(x.tolist() for x in np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4, 1)))))
    joined = components(range(len(values)), dense)
    assert sparse <= near and all((a, b) in sparse or joined[a] == joined[b] for a, b in near) and sparse and dense
    several = simhash.ball_edges(d.withColumn("several", F.lit(True)), len(values), 40, 1, 4, True)
    assert several.where("not dense").count() == 0
    assert components(range(len(values)), [(e.a // 7, e.b // 7) for e in several.collect()]) == components(range(len(values)), near)


def test_prefixes_bound_tasks_and_tables_find_pairs():
    for count in (0, 1000, 10**7, 10**10):
        bits, tables = simhash.plan_tables(count, 4, 0.8)
        prefix = simhash.plan_prefix(count, bits, tables, 4)
        assert count * simhash._ball(prefix, 2) / 2**prefix <= simhash.MOST_RECORDS and tables << prefix >= simhash.LEAST_TASKS and bits <= 62
    flips = np.random.default_rng(1).random((20_000, 40)) < np.arccos(1.6 / 1.8) / np.pi
    found = 1 - (1 - (flips.sum(1) <= 4).mean()) ** simhash.plan_tables(1000, 4, 0.8)[1]
    assert found >= 0.985


@pytest.mark.parametrize("width", [64, 384])
def test_parity_sketches_rule_out_no_similar_pair(spark, width):
    rng, rows, similar = np.random.default_rng(width), [], []
    for size in (0, 1, 4, 9, 80, 900):
        base = rng.integers(0, 1 << 63, size, np.uint64)
        for changed in sorted({0, 1, size // 9, size // 8, size // 4, size}):
            other = np.unique(np.r_[base[min(changed, size) :], rng.integers(0, 1 << 63, changed, np.uint64)])
            both = len(np.intersect1d(base, other))
            similar.append(both >= 0.8 * (len(base) + len(other) - both))
            a, b = (simhash.parity_sketch(np.unique(x), width).view(np.int64) for x in (base, other))
            rows.append((len(rows), a.tolist(), b.tolist(), [int(a[0]) | simhash.MOST, *a.tolist()[1:]]))
    d = spark.createDataFrame(rows, "k int, a array<long>, b array<long>, c array<long>")
    maybe = lambda a, b: simhash.may_be_similar(F.col(a), F.col(b), width, 0.8)
    got = d.select("k", maybe("a", "b").alias("m"), maybe("c", "b").alias("n")).orderBy("k").collect()
    assert all(r.m or not s for r, s in zip(got, similar)) and sum(not r.m for r in got) > 3 and all(r.n for r in got)


def test_dense_family_below_the_similarity_loses_no_link(spark):
    rng = random.Random(4)
    base, rows = [f"g{i}" for i in range(300)], []

    def change(words, n):
        words = list(words)
        for at in rng.sample(range(0, 300, 5), n):
            words[at] = f"x{rng.randrange(10**9)}"
        return words

    family = [change(base, 4) for _ in range(2000)]
    family += [change(rng.choice(family), 5) for _ in range(200)]
    rng.shuffle(family)
    rows = [(i, " ".join(words)) for i, words in enumerate(family)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    n, tables = len(rows), simhash.plan_tables(len(rows), 4, 0.8)[1]
    sketch = simhash.sketch_column(5, tables, 40, 384)("text")
    fps = np.array([r.fps for r in d.select("doc_id", sketch.alias("s")).orderBy("doc_id").select("s.fps").collect()], np.int64).view(np.uint64)
    meet = np.zeros((n, n), bool)
    for t in range(tables):
        meet |= np.bitwise_count(fps[:, t, None] ^ fps[None, :, t]) <= 4
    sets = [np.unique(simhash.shingle_hashes(simhash.words_of(t), 5)) for _, t in rows]
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    matrix = np.zeros((n, at.max() + 1), np.float32)
    matrix[np.repeat(np.arange(n), [len(s) for s in sets]), at] = 1
    both = matrix @ matrix.T
    size = np.array([len(s) for s in sets])
    near = np.triu(both >= 0.8 * (size[:, None] + size - both), 1)
    assert near.sum() < 0.02 * n * n and (near & meet).sum() > 150
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_ids(d).collect()}
    assert not [(i, j) for i, j in np.argwhere(near & meet).tolist() if got[i] != got[j]]
    true = components(range(n), np.argwhere(near).tolist())
    assert all(true[i] == true[c] for i, c in got.items())


@pytest.mark.parametrize("repeats", [2, 5, 10])
def test_repeated_passages_do_not_move_fingerprints(spark, repeats):
    rng = random.Random(repeats)
    texts = []
    for k in range(40):
        words = [f"w{k}_{i}" for i in range(204)]
        at = rng.randrange(180)
        texts += [" ".join(words), " ".join(words[:at] + words[at : at + 20] * (1 + repeats) + words[at + 20 :])]
    a, b = (set(simhash.shingle_hashes(simhash.words_of(t), 5).tolist()) for t in texts[:2])
    assert len(a & b) >= 0.95 * len(a | b)
    fps = np.array(simhash.sketch_column(5, 10, 40, 384).func(pd.Series(texts))["fps"].tolist(), np.int64).view(np.uint64)
    assert (np.bitwise_count(fps[::2] ^ fps[1::2]) <= 4).any(1).sum() >= 39


def test_deduplicate_keeps_one_of_each_group(spark, hard, empty):
    got = simhash.deduplicate(hard)
    assert got.columns == hard.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [0, *range(1, 12), 12, 15, 16] and got.where("doc_id is null").count() == 1
    assert simhash.deduplicate(empty).count() == 0 and simhash.simhash_components(empty).count() == 0


def test_deduplicate_with_clashing_ids_and_names(spark):
    rng = random.Random(6)
    one, two = prose(rng, 80), prose(rng, 80)
    rows = [("d1", one), ("d1", two), ("d0", one + " more"), ("d2", two.upper()), ("d1", two), ("d3", None), ("d4", " "), (None, one), ("d5", "a b")]
    d = spark.createDataFrame(rows, "doc_id string, text string").withColumns({c: F.lit(c) for c in ("__id", "__copies", "row", "i", "k", "n", "digest", "`a b`", "x.y")})
    got = simhash.deduplicate(d)
    assert got.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id) == sorted([("d0", one + " more"), ("d1", two), ("d3", None), ("d5", "a b")])
    assert got.where("doc_id is null").count() == 1
    groups = simhash.near_duplicate_ids(d).collect()
    assert sorted((r.doc_id, r.component_id, r.copies) for r in groups) == [("d0", "d0", 1), ("d1", "d0", 1), ("d1", "d1", 2), ("d2", "d1", 1), ("d3", "d3", 1), ("d4", "d3", 1), ("d5", "d5", 1)]


# --- 3: WARC -----------------------------------------------------------------------------------------------------------


def test_warc_round_trip_and_audit(spark, tmp_path):
    d = spark.createDataFrame([(i, f"http://h/{i}", f"<p>é{i}</p>" * (i * 40 + 1)) for i in range(300)] + [(300, None, None)], "page_id long, url string, html string")
    r = d.select("page_id", F.concat(F.lit("a"), (F.col("page_id") % 2).cast("string"), F.lit(".warc")).alias("archive"), warc.warc_record(F.col("url"), F.col("html"), warc.record_uuid(F.col("page_id")), F.lit("2024-01-01T00:00:00Z")).alias("record"))
    laid = warc.lay_out(r.withColumn("length", F.octet_length("record").cast("long")), "page_id")
    for compress in (False, True):
        warc.write_warc(laid, f"file://{tmp_path}/{compress}", compress).collect()
        back = warc.read_warc(spark, f"file://{tmp_path}/{compress}")
        assert back.count() == 301 and back.where("headers['WARC-Target-URI'] = 'http://h/7'").first().record == laid.where("page_id = 7").first().record
    one = common.save(warc.record_hashes(laid), "one")
    assert warc.audit(one, one).count() == 0
    change = F.when(F.col("offset") % 7 == 3, F.lit("0" * 64)).otherwise(F.col("sha256"))
    gone = one.where("offset % 11 <> 5").withColumn("sha256", change)
    more = gone.unionAll(one.limit(1).withColumns({"offset": F.lit(10**9).cast("long")}))
    a, b = {(x.archive, x.offset): x.sha256 for x in one.collect()}, {(x.archive, x.offset): x.sha256 for x in more.collect()}
    want = {k: "missing" if k not in b else "extra" if k not in a else "corrupt" for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    assert {(x.archive, x.offset): x.kind for x in warc.audit(one, more).collect()} == want
    assert warc.audit(one.limit(0), one.limit(0)).count() == 0


def test_fixity_audits_every_record_of_both_sides(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h/{i}", f"<p>e{i}</p>") for i in range(120)] + [(None, f"http://n/{i}", "<p>e</p>") for i in range(9)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    sides = []
    audit = warc.audit
    monkeypatch.setattr(warc, "audit", lambda left, right: sides.extend((left, right)) or audit(left, right))
    bad = [i for i in range(120) if hashlib.md5(str(i).encode()).hexdigest()[:2] in queries.DAMAGED]
    assert queries.op3_warc_fixity(spark, str(tmp_path)).count() == len(bad)
    left, right = sides
    assert left.count() == right.count() == 129 and left.where("archive like 'pages-null-%'").count() == 9
    assert right.where("sha256 is null").count() == 0


def test_broken_archives():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [(o, n) for o, n, _, _ in warc.parse_warc(good * 2 + b"WARC/1.1\r\nrubbish")] == [(0, len(good)), (len(good), len(good)), (2 * len(good), 17)]
    assert list(warc.parse_warc(b"")) == []


# --- 4: decontamination ------------------------------------------------------------------------------------------------


def best_windows(docs, items, shingle=5, least=0.8):
    out = {}
    for i, t in items:
        w = simhash.words_of(t)
        if not w:
            continue
        n = min(shingle, len(w))
        want = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        for d, text in docs:
            u = simhash.words_of(text)
            s = [tuple(u[k : k + n]) for k in range(len(u) - n + 1)]
            span = min(len(w), len(u)) - n + 1
            sims = []
            for a in range(len(s) - span + 1) if span > 0 else ():
                have = Counter(s[a : a + span])
                both = sum((have & want).values())
                sims.append(both / (sum(want.values()) + span - both))
            if sims and max(sims) >= least:
                out[d, i] = (sims.index(max(sims)), max(sims))
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(8, 60))) for i in range(25)] + [(90, "two words"), (91, None), (92, "")]
    docs = []
    for d in range(80):
        words = prose(rng, rng.randint(1, 150)).split()
        if d % 2:
            passage = items[d % 25][1].split()
            for _ in range(d % 3):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((d, " ".join(words)))
    docs += [(100, "Two  WORDS"), (101, None), (102, ""), (None, items[0][1]), (103, items[3][1] + " " + items[3][1]), (104, "here are two words and more"), (105, "two other words")]
    items += [(93, items[3][1]), (94, items[3][1].upper())]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in decontaminate.contaminated(d, b, block_bytes=1500).collect()}
    want = best_windows(docs, items)
    assert got[100, 90] == (0, 1.0) and got[104, 90] == (2, 1.0) and got[103, 93] == got[103, 94] == (0, 1.0)
    assert got.keys() == want.keys() and all(got[k] == (want[k][0], pytest.approx(want[k][1])) for k in got)
    kept = decontaminate.decontaminate(d, b)
    assert {r.doc_id for r in kept.collect()} == {None} | {x for x, _ in docs} - {k for k, _ in want}
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), b).count() == 0


def test_windows_and_overlaps_slide():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 40, 5000, np.uint64)
    for span in (1, 7, 3000):
        got = np.concatenate([f for _, f in decontaminate.window_fingerprints(keys, span)])
        want = keys[100 : 100 + span]
        wanted, times = np.unique(want, return_counts=True)
        both = decontaminate.overlaps(keys, span, wanted, times)
        assert len(got) == len(both) == len(keys) - span + 1
        for w in [0, 1, 100, *rng.integers(0, len(got), 20).tolist(), len(got) - 1]:
            own = keys[w : w + span]
            assert (got[w] == decontaminate.fingerprints(decontaminate.key_bits(own).sum(0, dtype=np.int64), span)[0]).all()
            assert both[w] == sum((Counter(own.tolist()) & Counter(want.tolist())).values())


def test_index_finds_all_within_the_radius_and_few_others():
    rng = random.Random(5)
    items = [(str(i), prose(rng, 40, [f"v{i}" for i in range(3000)])) for i in range(200)]
    index = decontaminate.Index(items)
    marks = [decontaminate.fingerprints(decontaminate.key_bits(simhash.shingle_keys(np.array([xxhash.xxh64_intdigest(w) for w in simhash.words_of(t)], np.uint64), 5)).sum(0), 36)[0] for _, t in items]
    others = 0
    for i, mark in enumerate(marks):
        assert i in index.candidates(mark[None], 40)
        flat = np.unpackbits(mark.view(np.uint8))
        flat[rng.sample(range(len(flat)), decontaminate.RADIUS)] ^= 1
        found = index.candidates(np.packbits(flat).view("<u2")[None], 40)
        assert i in found and not len(index.candidates(mark[None], 41))
        others += len(index.candidates(mark[None], 40)) - 1
    assert others < 0.02 * 200 * 200


def test_long_items_in_long_documents_take_time_by_their_length():
    import time

    w = [f"w{i % 9000}" for i in range(20_000)]
    index = decontaminate.Index([("a", " ".join(w)), ("b", " ".join(w[:30]))])
    began = time.process_time()
    got = index.search(" ".join([f"x{i}" for i in range(20_000)] + w + [f"y{i}" for i in range(20_000)]))
    assert sorted(got) == [("a", 20_000, 20_000, 1.0), ("b", 20_000, 30, 1.0)] and time.process_time() - began < 10


def test_decontamination_with_ids_of_other_types(spark):
    d = spark.createDataFrame([("d1", "one two three four five six seven"), (None, "one two three four five six seven"), ("d2", "no")], "doc_id string, text string")
    b = spark.createDataFrame([("x", "One two three four five six")], "item_id string, text string")
    d = d.withColumns({c: F.lit(1) for c in ("__bad", "name", "t", "id")})
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()} == {("d1", "x"), (None, "x")}
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["None", "d2"]
    assert decontaminate.contaminated(d, b.limit(0)).dtypes[0] == ("doc_id", "string")


def test_decontamination_of_hard_rows(spark, hard):
    b = spark.createDataFrame([(1, hard.where("doc_id = 3").first().text)], "item_id long, text string")
    got = decontaminate.decontaminate(hard, b)
    assert got.columns == hard.columns and got.count() == hard.count() - 1


# --- 5: embeddings -----------------------------------------------------------------------------------------------------


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, base = [], rng.normal(size=(150, 24))
    for i, v in enumerate(base):
        rows.append((i, v.tolist()))
    rows += [(1000 + k, (base[k % 9] + rng.normal(size=24) * 0.12).tolist()) for k in range(60)]
    rows += [(2000, base[3].tolist()), (2001, (base[3] * 7).tolist()), (2001, base[3].tolist())]
    bad = [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [float("nan")] + [1.0] * 23), (3004, [None] + [1.0] * 23), (3005, [float("inf")] * 24), (3006, [1.0, 2.0]), (None, None)]
    d = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "uid": F.lit(2), "copies": F.lit(3)})
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    root = components(range(len(rows)), zip(*(a.tolist() for a in np.nonzero(near))))
    least = {}
    for k, r in root.items():
        least[r] = min(least.get(r, 1 << 60), rows[k][0])
    want = sorted((rows[k][0], int(near[k].sum()), least[root[k]]) for k in range(len(rows)))
    got = embeddings.near_duplicates(d).collect()
    # the index finds at least nine of ten links, here all of them
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id < 3000) == want
    lone = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None or r.vec_id >= 3000}
    assert lone == {v: (0, v, v is not None) for v, _ in bad}
    assert embeddings.near_duplicates(d.limit(0)).count() == 0


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(1, 16)) + rng.normal(size=(90, 16)) * 0.05, rng.normal(size=(60, 16))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(embeddings.near_duplicates(d).collect())
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    assert sorted(embeddings.near_duplicates(d).collect()) == whole and max(r.n_links for r in whole) >= 80


def cone(rng, n, dim, mean):
    """Unit vectors with this mean cosine between them, and for each another one a bit above cosine 0.95 from it."""
    axis, r, z = np.eye(dim)[0], rng.normal(size=(n, dim)), rng.normal(size=(n, dim))
    r[:, 0] = z[:, 0] = 0
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    z -= (z * r).sum(1, keepdims=True) * r
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = (0.951 - mean) / (1 - mean)
    return np.sqrt(mean) * axis + np.sqrt(1 - mean) * r, np.sqrt(mean) * axis + np.sqrt(1 - mean) * (c * r + np.sqrt(1 - c * c) * z)


@pytest.mark.parametrize("dim", [64, 384])
@pytest.mark.parametrize("wanted, mean", [(512, 0.0), (2048, 0.0), (8192, 0.0), (512, 0.8), (2048, 0.9)])
def test_index_finds_pairs_at_the_threshold(dim, wanted, mean):
    rng = np.random.default_rng(wanted)
    middle, points, prefix, shared = embeddings.fit_index(cone(rng, 4 * wanted, dim, mean)[0], wanted, (wanted // 2) ** 2, 0.95, 6, 2)
    near = [embeddings.nearest(embeddings.centred(x, middle), points, prefix) for x in cone(rng, 2000, dim, mean)]
    assert ((near[0][:, :, None] == near[1][:, None, :]).any(2).sum(1) >= shared).mean() >= 0.95
    lists = np.unique(embeddings.list_keys(near[0], shared))
    assert len(lists) >= 1000


def test_concentrated_embeddings_against_brute_force(spark):
    x = np.concatenate(cone(np.random.default_rng(8), 700, 32, 0.8))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(d).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.95 * want.sum() >= 1000
    same = spark.createDataFrame([(i, [1.0, 1e-9 * i, 0.0]) for i in range(40)], "vec_id long, embedding array<double>")
    assert {r.n_links for r in embeddings.near_duplicates(same).collect()} == {39}


# --- 6: lines ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("few", [0, 200_000])
def test_lines_against_brute_force(spark, few, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW_LINES", few)
    rng = random.Random(8)
    rows = []
    for i in range(120):
        lines = [prose(rng, 5) for _ in range(rng.randint(0, 5))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), "  Footer   of the\tsite ")
        if i % 40 == 0:
            lines += ["rare", "rare"]
        rows.append((i, f"h{i % 2}" if i % 7 else None, "\n".join(lines) if i % 11 else None))
    rows += [rows[3]] * 2
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(c) for c in ("host", "key", "pages", "__i", "__bad", "row", "t", "h", "x.y")})
    rows += [(200, "small", "one\ntwo"), (201, "small", "one\nthree"), (202, "alone", "four")]
    d = d.unionByName(spark.createDataFrame(rows[-3:], "doc_id long, source string, text string"), allowMissingColumns=True)
    plain = lambda x: " ".join(x.split())
    hosts, counts = Counter(r[1] for r in rows), Counter()
    for _, h, t in rows:
        counts.update({(h, plain(x)) for x in (t or "").split("\n") if plain(x)})
    bad = {k for k, n in counts.items() if n >= 2 and n > 0.1 * hosts[k[0]]}
    assert ("small", "one") in bad and ("alone", "four") not in bad
    want = sorted((i, str(None if t is None else "\n".join(x for x in t.split("\n") if (h, plain(x)) not in bad))) for i, h, t in rows)
    got = line_dedup.drop_boilerplate_lines(d)
    assert sorted((r.doc_id, str(r.text)) for r in got.collect()) == want and bad
    assert got.where("text is null and n_lines <> 0").count() == 0 and got.agg(F.sum("n_dropped")).first()[0] > 0


def test_lines_of_hard_rows(hard, empty):
    got = line_dedup.drop_boilerplate_lines(hard)
    assert got.count() == hard.count() and set(hard.columns) <= set(got.columns) and line_dedup.drop_boilerplate_lines(empty).count() == 0


# --- 7: language model -------------------------------------------------------------------------------------------------


def test_language_model(spark, data):
    got = queries.op7_lm_scoring(spark, data).toPandas()
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    words = {d: (t or "").encode().lower().split() + [b""] for d, t in zip(docs.doc_id, docs.text)}
    counts = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in got.itertuples():
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (held.score > held.base_score).mean() > 0.9


def test_language_model_is_a_distribution(spark):
    """The probabilities of all words after a history, unknown words of each class as one, add up to one."""
    rng = random.Random(1)
    d = spark.createDataFrame([(i, prose(rng, 80)) for i in range(40)], "doc_id long, text string")
    m = lm.train(d, head=100)
    assert m.counts.count() > 0
    v = m.vocabulary
    # after the head word 3: all head words and the end, and the classes of further words
    ids = np.array([*range(v.words + 1), *(-1 - k for k in range(lm.TAIL_ENDINGS))])
    p = np.array([10 ** m.weights.logs(v, np.array([3, i]), np.array([1]))[1] for i in ids])
    head, tail = p[: v.words + 1], p[v.words + 1 :]
    inside = np.zeros(lm.TAIL_ENDINGS)
    for r in m.counts.collect():
        k = lm._ending(bytes(r.word)) % lm.TAIL_ENDINGS
        inside[k] += (r.c + 1) / 10 ** m.log_tail_mass[k]
    inside += 1 / 10**m.log_tail_mass
    assert inside == pytest.approx(1.0) and head.sum() + tail.sum() == pytest.approx(1.0, abs=2e-3)
    # a class's probability is that of its words
    cls = v.classes(ids)
    f = lm.outer_buckets(v.histories(np.array([3, v.words]), v.classes(np.array([3, v.words])), np.array([1])))[:, 1:]
    x, _, total = lm._softmax(m.weights.outer, m.weights.bias, f)
    for k in set(cls.tolist()):
        assert p[cls == k].sum() == pytest.approx(float(np.exp(x[0, k]) / total[0]), rel=1e-3)


@pytest.mark.parametrize("by_row", [False, True])
def test_gradient_step_against_plain_loops(by_row):
    rng = np.random.default_rng(3)
    w, sq = rng.normal(size=(40, 6)).astype(np.float32), rng.random((40, 6)).astype(np.float32)
    f, want = rng.integers(0, 40, (3, 50)), rng.integers(0, 6, 50)
    bias = rng.normal(size=(50, 6) if by_row else 6).astype(np.float32)
    left, squares = w.astype(float), sq.astype(float)
    p = np.zeros((50, 6))
    for t in range(50):
        x = sum(left[f[j, t]] for j in range(3)) + (bias[t] if by_row else bias)
        p[t] = np.exp(x) / np.exp(x).sum()
        p[t, want[t]] -= 1
    for j in range(3):
        for b in set(f[j].tolist()):
            g = p[f[j] == b].sum(axis=0)
            squares[b] += g * g
            left[b] -= 0.15 * g / np.sqrt(squares[b] + 1)
    before = w.copy()
    lm.gradient_pass(w, bias, sq, f, want, 0.15, np.empty((3, 64, 6), np.float32))
    assert w == pytest.approx(left, abs=1e-4) and sq == pytest.approx(squares, abs=1e-3) and not np.allclose(w, before)


@pytest.mark.parametrize("kinds", [1, 3, 200, 4000])
def test_sums_of_runs(kinds):
    """Runs of any length, one to all rows, against reduceat."""
    rng = np.random.default_rng(kinds)
    rows, keys = rng.normal(size=(3000, 5)).astype(np.float32), np.sort(np.minimum(rng.integers(0, kinds, 3000), rng.integers(0, kinds, 3000)))
    order, start = rng.permutation(3000), np.flatnonzero(np.diff(keys, prepend=-1))
    by, got = lm.sums_of_runs(rows, order, start)
    assert sorted(by) == list(range(len(start))) and got == pytest.approx(np.add.reduceat(rows[order], start, axis=0)[by], abs=1e-3)


def test_second_softmax_learns_what_follows():
    """Words of one class that follow different words: slots tell them apart after training, counts can't."""
    words = [b"w%03d" % i for i in range(lm.SINGLE)] + [b"one-xyz", b"two-xyz"]
    v = lm.Vocabulary(words, [1000] * len(words), 10)
    a, b = lm.SINGLE, lm.SINGLE + 1
    assert v.cls[a] == v.cls[b] and v.slot[a] != v.slot[b]
    ids = np.array([0, a, 1, b] * 300 + [v.words])
    m = lm.Model(None, v, np.zeros(lm.TAIL_ENDINGS), 10_000, len(words), 1)
    untrained = m.weights.logs(v, ids, np.array([len(ids) - 1]))
    zeros = np.zeros_like(m.weights.outer), np.zeros_like(m.weights.inner)
    for _ in range(20):
        m.weights.learn(zeros, m.weights.rooms(), v, ids, np.array([len(ids) - 1]), (0.15, 0.15))
    trained = m.weights.logs(v, ids, np.array([len(ids) - 1]))
    assert trained.mean() > untrained.mean() / 3
    flat = lm.Weights(m.weights.outer, np.zeros_like(m.weights.inner), m.weights.bias, m.weights.slot_bias).logs(v, ids, np.array([len(ids) - 1]))
    assert trained.mean() - flat.mean() > 0.5 * np.log10(2) * 0.8


def test_mean_of_changes_of_many_tokens():
    """A task's tokens times its change are far beyond what half precision holds."""
    changes = [np.array(c, np.float16).tobytes() for c in ([0.5, -1.0], [1.5, 2.0])]
    got = lm.mean_change(pd.Series([3_000_000, 1_000_000]), pd.Series(changes), np.float16)
    assert got.dtype == np.float32 and got == pytest.approx([0.75, -0.25])


def test_language_model_of_large_shares(spark):
    """Tasks that learn from more than 65,504 tokens, each word one of two that follow the word before."""
    rng = random.Random(5)
    texts = [" ".join(f"w{k % 400}" for k in accumulate(rng.choices((1, 2), k=1_000))) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    m = lm.train(d.where("doc_id >= 15"))
    assert np.isfinite(m.weights.flat()).all() and np.abs(m.weights.flat()).max() > 0.7
    got = lm.score(d.where("doc_id < 15"), m).collect()
    assert all(np.isfinite(r.score) for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_language_model_of_hard_rows(hard, empty):
    m = lm.train(hard)
    got = lm.score(hard, m).collect()
    assert len(got) == hard.count() and all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert sorted(r.n_tokens for r in got)[:4] == [1, 1, 1, 4] and [r.doc_id for r in got].count(None) == 1
    none = lm.train(empty)
    assert all(np.isfinite(r.score) for r in lm.score(hard, none).collect()) and lm.score(empty, none).count() == 0


# --- 8: mixing ---------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    out, capped, total = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        share = total - sum(3 * sizes[s] for s in capped)
        out = {s: 3.0 * sizes[s] for s in capped} | {s: share * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if out[s] > 3 * sizes[s]}
        if not over:
            return out
        capped |= over


def test_targets(spark):
    rng = random.Random(2)
    for sizes in ({"a": 10, "b": 1, "c": 1, None: 5}, {f"s{i}": rng.randrange(1, 10 ** rng.randrange(1, 6)) for i in range(30)}, {"a": 0, "b": 0}, {"é": 1, "z": 100, "Z": 3, "": 0}):
        with common.Scratch() as scratch:
            got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), scratch).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_mix_is_whole_words_in_order(spark):
    rng = random.Random(3)
    d = spark.createDataFrame([(i, f"s{i % 3}", " ".join(f"d{i}w{k}" for k in range(rng.randrange(0, 90)))) for i in range(60)], "doc_id long, source string, text string")
    documents, sources, pieces = mixing.mix(d, block=16, shard=8)
    size = {r.source: (r.source_size, r.target) for r in sources.collect()}
    texts = mixing.mixed_texts(d, pieces).collect()
    for s, (n, target) in size.items():
        words = [w for r in texts if r.source == s for w in r.text.split()]
        assert abs(len(words) - target) <= 0.5 and max(Counter(words).values()) <= 3
        assert len(set(words)) == min(n, len(set(words)))
    assert len({r.shard for r in texts}) > 3 and len({(r.source, r.slot) for r in texts}) == len(texts)
    assert sorted(mixing.mix_digest(d, block=16).collect()) == sorted(mixing.mix_digest(d.repartition(7), block=16).collect())


def test_mix_of_hard_rows(hard, empty):
    got = mixing.mix_digest(hard).collect()
    assert len(got) == hard.count() and all(r.taken <= 3 * r.size for r in got) and mixing.mix_digest(empty).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(taken - target) <= 0.5 for target, taken in by.values())


def test_small_sources_meet_their_targets(spark):
    d = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 300).alias("source"), F.array_join(F.array_repeat(F.lit("w"), 30), " ").alias("text"))
    by = mixing.mix_digest(d).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("target")).collect()
    assert len(by) == 300 and all(abs(r.n - r.target) <= 0.5 for r in by)


def test_draws_are_multinomial_and_settled(spark):
    """Counts of a shard vary as draws do, totals are exact, and each slot of each source is filled once."""
    want = {"a": 700, "b": 200, None: 97, "c": 3}
    rows, low = [], 0
    for s, n in want.items():
        rows.append((s, n, low))
        low += n
    with common.Scratch() as scratch:
        got = mixing.draw_slots(spark.createDataFrame(rows, "source string, slots long, low long"), 1000, 50, 3, scratch).collect()
    assert Counter(r.source for r in got) == want and sorted(r.place for r in got) == list(range(1000)) and all(r.shard == r.place // 50 for r in got)
    assert all(sorted(r.slot for r in got if r.source == s) == list(range(n)) for s, n in want.items())
    counts = Counter(r.shard for r in got if r.source == "a")
    spread = np.std([counts[k] for k in range(20)])
    assert 1.5 < spread < 6  # the draws' is 3.2; fixed shares would have none


@pytest.mark.parametrize("blocks", [1, 2, 3, 50, 1001])
def test_blocks_are_permuted(spark, blocks):
    m = max(blocks - 1, 1)
    turns = [[(7 * e + 13 * r * r + 5) % m for r in range(mixing.ROUNDS)] for e in range(2)]
    d = spark.range(2 * blocks).select((F.col("id") / blocks).cast("int").alias("e"), (F.col("id") % blocks).alias("at"), F.lit(blocks).cast("long").alias("blocks"), F.lit("k").alias("key"), F.from_json(F.lit(str(turns)), "array<array<long>>").alias("turns"))
    got = d.select("e", "at", mixing.permuted().alias("b")).orderBy("e", "at").collect()
    orders = [[r.b for r in got if r.e == e] for e in range(2)]
    assert all(sorted(o) == list(range(blocks)) and o[-1] == blocks - 1 for o in orders) and (blocks < 50 or orders[0] != orders[1] != sorted(orders[1]))


# --- 9: quality --------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    got = queries.op9_quality(spark, d).toPandas()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas().set_index("doc_id").quality
    held = got[got.held_out & got.doc_id.isin(labels.index)]
    truth = held.doc_id.map(labels)
    assert (held.predicted == truth).mean() >= 0.95 and held.predicted[truth == 1].mean() >= 0.97
    assert sorted(queries.op9_quality(spark, d).collect()) == sorted(tuple(r) for r in got.itertuples(index=False))


def test_quality_of_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(1, 1), (16, 0), (12, None), (99, 1), (None, 1), (2, 7)], "doc_id long, quality int")
    w = quality.train(hard, labels)
    got = {r.doc_id: r.score for r in quality.score(hard, w).collect()}
    assert got[16] < 0.5 < got[1] and got[12] == got[13] == got[14] and quality.score(empty, w).count() == 0
    assert quality.keep_good(hard, w).columns == hard.columns
    assert (quality.train(hard, labels.limit(0)) == 0).all()


# --- 10: chat ----------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "\\", "\\|", "<\\|", "<<|", "a\\\\|b", "<|im_sep|>", "é😀\n\n", "", None, "<\\<|\\"]
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "ro<|le\n", None]), rng.choice(nasty)) for c in [*range(20), None] for t in rng.sample(range(-5, 900), 7)]
    rows += [(1, None, "user", "first"), (2, 3, "user", "tie"), (2, 3, "user", "tie"), (2, 3, "assistant", "tie")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(1), "chunk": F.lit(2), "at": F.lit(3)})
    got = chat.format_chat(d).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("m"), "mask").collect()
    assert len(got) == 21
    for r in got:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id), key=lambda x: x[:3])
        assert [(x.role, x.text) for x in r.t] == [x[2:] for x in turns]
        assert r.m == "".join(x[3] for x in turns if x[2] == "assistant") and len(r.mask) == sum(x[2] == "assistant" for x in turns)
    assert chat.format_chat(d.limit(0)).count() == 0


def test_chat_parts(spark):
    part = lambda k, text=None, ref=None, n=None: (k, text, ref, n)
    rows = [(1, 0, "user", [part("text", "look: "), part("image", ref="a.png"), part("audio", ref="b.wav", n=9), part("document", ref="c.pdf")]), (1, 1, "assistant", [part("text", "<|image|>")]), (1, 2, "user", None)]
    d = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chat(d, parts=F.col("parts")).first()
    assert "look: <|image|><|audio|><|document|><|im_end|>" in r.formatted and r.formatted.count("<|image|>") == 1
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 576), ("audio", "b.wav", 9), ("document", "c.pdf", 1024)] and r.expanded_tokens == 576 + 9 + 1024


def test_chat_query(spark, data):
    got = {r.conv_id: r for r in queries.op10_chat(spark, data).collect()}
    turns = spark.read.parquet(f"{data}/conversations.parquet").toPandas().sort_values("turn")
    for conv, g in turns.groupby("conv_id"):
        said = "".join(f"{a}\n{b or ''}\n" for a, b in zip(g.role, g.text))
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[conv].n_turns == len(g)
    assert got[-1].loss_chars == len("<|im_end|><|im_start|>assistant ok")


# --- SQL ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(name, spark, data):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    got, want = queries.queries()[name](spark, data).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    as_rows = lambda f: sorted(tuple(map(str, r)) for r in f[sorted(f.columns)].itertuples(index=False))
    assert as_rows(got) == as_rows(want)
