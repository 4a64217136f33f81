"""Vector searches, reply trees, link graphs and the corpus pipeline against brute force."""

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadmill.llm import chat, topk, urlgraph, vectors, vptree
from threadmill.llm import queries as llm_queries

VECTORS = "vec_id long, embedding array<float>, dim int"


def vector_rows(n=900, dims=6):
    rng = np.random.default_rng(5)
    points = np.round(rng.normal(size=(n, dims)), 1)
    points[100:160] = points[0]  # ties
    rows = [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]
    odd = [None, [], [None] * dims, [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [0.0] * dims]
    return rows + [(2000 + i, v, 0) for i, v in enumerate(odd)] + [(None, [1.0] * dims, 0), (3000, [1.0, 2.0], 0), (3001, [1.0, 3.0], 0)]


def usable(rows, zeros):
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v]
    return [(i, v) for i, v in kept if np.isfinite(v).all() and (zeros or v.any())]


def first(rows, queries, k, score, largest):
    out = []
    for q, a in queries:
        found = sorted((-score(a, b) if largest else score(a, b), i) for i, b in rows if i != q and len(a) == len(b))
        out += [(q, r, i, -s if largest else s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def listed(frame):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in frame.collect())


def test_factor_one_is_exact(spark):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, VECTORS)
    index = vptree.build(frame, shard_rows=200)
    got = listed(vptree.search(index, frame.where("vec_id % 100 = 0"), 10, 1.0, query_rows=3))
    plain = usable(rows, False)
    want = first(plain, [r for r in plain if r[0] % 100 == 0], 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
    assert vptree.nearest(frame.limit(0), frame).count() == 0


def test_relaxed_search_finds_most(spark):
    rows = vector_rows(3000, 16)
    frame = spark.createDataFrame(rows, VECTORS)
    queries = frame.where("vec_id % 50 = 0")
    exact, near = (listed(vptree.nearest(frame, queries, 10, f)) for f in (1.0, 1.3))
    assert len({x[:1] + x[2:3] for x in exact} & {x[:1] + x[2:3] for x in near}) >= 0.9 * len(exact)


@pytest.mark.parametrize("scale", [256, 1 << 40])
def test_products_are_exact(spark, scale):
    rows = vector_rows(400)
    frame = spark.createDataFrame(rows, VECTORS)
    got = listed(topk.search(frame, frame.where("vec_id % 50 = 0"), 5, scale))
    whole = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in usable(rows, True)]
    low, high = -(1 << 63), (1 << 63) - 1
    product = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), low), high)
    assert got == first(whole, [r for r in whole if r[0] % 50 == 0], 5, product, True)
    assert topk.search(frame.limit(0), frame.limit(0)).count() == 0


def counted(monkeypatch, module):
    """Collects the shares of (query, shard) pairs that a search keeps."""
    shares, plain = [], module.routed

    def routed(rows, asked, shards, able, block):
        kept = asked.join(shards.withColumnRenamed("dim", "d"), F.col("dim") == F.col("d")).where(able).count()
        shares.append(kept / (asked.count() * shards.count()))
        return plain(rows, asked, shards, able, block)

    monkeypatch.setattr(module, "routed", routed)
    return shares


def test_clustered_vectors_go_to_few_shards(spark, monkeypatch):
    rng = np.random.default_rng(9)
    points = np.round(rng.normal(size=(12, 6))[rng.integers(0, 12, 2400)] * 20 + rng.normal(size=(2400, 6)), 2)
    rows = [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]
    frame, shares = spark.createDataFrame(rows, VECTORS), counted(monkeypatch, vptree)
    got = listed(vptree.search(vptree.build(frame, shard_rows=100), frame.where("vec_id % 100 = 0"), 10, 1.0, query_rows=3))
    plain = usable(rows, False)
    want = first(plain, [r for r in plain if r[0] % 100 == 0], 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False)
    assert [g[:3] for g in got] == [w[:3] for w in want] and shares[0] < 0.5


def test_many_shards_meet_queries_in_blocks(spark, monkeypatch):
    """Beyond the size that is sent no join goes by the dimension alone, and results stay exact."""
    rng = np.random.default_rng(12)
    points = np.round(rng.normal(size=(600, 5)), 2)
    rows = [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, VECTORS)
    for name, value in (("SENT_BYTES", 0), ("GRID_QUERIES", 7), ("GRID_SHARDS", 3)):
        monkeypatch.setattr(vectors, name, value)
    keys = []

    def beside(*args, real=vectors._beside):
        found = real(*args)
        keys.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(vectors, "_beside", beside)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = listed(vptree.search(vptree.build(frame, shard_rows=50), frame.where("vec_id % 20 = 0"), 10))
        assert listed(topk.search(frame, frame.where("vec_id % 20 = 0"), 5))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    plain = usable(rows, False)
    want = first(plain, [r for r in plain if r[0] % 20 == 0], 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for plan in keys:
        joins = [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
        assert len(keys) == 2 and any("row#" in line and "column#" in line for line in joins)
        assert not any(re.search(r"Join \[[^,\]]*\],", line) for line in joins)


def test_cells_are_parted_again(spark, monkeypatch):
    """More rows than the first cells hold: still near one another, so few shards are searched; equal rows stay together."""
    monkeypatch.setattr(vptree, "CENTRES", 3)
    monkeypatch.setattr(vptree, "PART_ROWS", 100)
    rng = np.random.default_rng(13)
    points = np.round(rng.normal(size=(40, 6))[rng.integers(0, 40, 2000)] * 20 + rng.normal(size=(2000, 6)), 2)
    points[1700:] = points[1700]
    rows = [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]
    frame, shares = spark.createDataFrame(rows, VECTORS), counted(monkeypatch, vptree)
    index = vptree.build(frame, shard_rows=60).cache()
    assert index.count() == 2000 and index.groupBy("dim", "shard").count().agg({"count": "max"}).first()[0] <= 180
    asked = frame.where("vec_id % 100 = 0 AND vec_id < 1700")
    got = listed(vptree.search(index, asked, 10, 1.0, query_rows=3))
    plain = usable(rows, False)
    want = first(plain, [r for r in plain if r[0] % 100 == 0 and r[0] < 1700], 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False)
    assert [g[:3] for g in got] == [w[:3] for w in want] and shares[0] < 0.4


def test_short_vectors_are_not_sent(spark, monkeypatch):
    rng = np.random.default_rng(10)
    points = np.round(rng.normal(size=(1500, 4)) * rng.lognormal(0, 1.5, size=(1500, 1)), 2)
    rows = [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]
    frame, shares = spark.createDataFrame(rows, VECTORS), counted(monkeypatch, topk)
    got = listed(topk.search(frame, frame.where("vec_id % 50 = 0"), 5))
    whole = [(i, [int(np.floor(x * 256)) for x in v]) for i, v in usable(rows, True)]
    assert got == first(whole, [r for r in whole if r[0] % 50 == 0], 5, lambda a, b: sum(x * y for x, y in zip(a, b)), True) and shares[0] < 0.5


@pytest.mark.parametrize("peak", [300, 1 << 40])
def test_few_pairs_are_multiplied_alike(peak):
    rng = np.random.default_rng(11)
    a, b = rng.integers(-peak, peak, (9, 5)).astype(float), rng.integers(-peak, peak, (40, 5)).astype(float)
    for share in (0.0, 0.05, 0.9):
        able = rng.random((9, 40)) < share
        got = topk.pair_products(a, b, able)
        assert (got == np.where(able, topk.products(a, b), np.iinfo(np.int64).min)).all()


@pytest.mark.parametrize("dims", [1, 2, 6])
def test_products_of_one_strong_negative_coordinate(spark, dims):
    rng = np.random.default_rng(6)
    points = np.round(rng.normal(scale=0.3, size=(700, dims)), 2)
    points[:, 0] = -np.abs(np.round(rng.normal(2, 1, size=700), 2))
    rows = [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, VECTORS)
    got = listed(topk.search(frame, frame.where("vec_id % 20 = 0"), 5))
    whole = [(i, [int(np.floor(x * 256)) for x in v]) for i, v in usable(rows, True)]
    assert got == first(whole, [r for r in whole if r[0] % 20 == 0], 5, lambda a, b: sum(x * y for x, y in zip(a, b)), True)


def test_coordinate_bounds_at_the_negative_pole():
    points = np.array([[-256.0, 0.0], [-180.0, -182.0], [-180.0, 182.0]])
    query, own, ids = np.array([[-256.0, 0.0]]), np.array([9]), np.arange(3)
    _, names, scores = topk.bucket_top(ids, points, own, query, np.array([46080.0]), 3)
    assert dict(zip(names.tolist(), scores.tolist())) == {0: 65536, 1: 46080, 2: 46080}


# Reply trees

MESSAGES = "conv_id long, msg_id long, parent_id long, role string, text string, score double"


def plain_paths(rows, branches):
    out = set()
    by = defaultdict(dict)
    for c, m, p, role, text, score in rows:
        by[c][m] = (p, role or "", text or "", score or 0.0)
    for c, nodes in by.items():
        parents = {p for p, *_ in nodes.values()}
        found = []
        for leaf in nodes.keys() - parents:
            path, at = [], leaf
            while at in nodes and at not in path:
                path.append(at)
                at = nodes[at][0]
            if at not in path:
                found.append((-sum(nodes[m][3] for m in path) / len(path), leaf, path[::-1]))
        for b, (_, _, path) in enumerate(sorted(found)[:branches], 1):
            out.add((c, b, tuple((nodes[m][1], nodes[m][2]) for m in path)))
    return out


def test_reply_trees_equal_brute_force(spark):
    rng = random.Random(8)
    texts = ["", None, "### user: \\", " </turn>\n### a: ", "\\\\###", "é: \U0001f600", "plain"]
    rows = []
    for c in range(12):
        for m in range(rng.randint(1, 40)):
            parent = rng.choice([None, 999, *range(m)]) if m and rng.random() < 0.3 else (m - 1 if m else None)
            rows.append((c, m, parent, rng.choice(["user", "assistant", "a: ###", None]), rng.choice(texts), rng.choice([None, 0.5, 1.0, 2.0])))
    rows += [(50, 1, 2, "user", "x", 1.0), (50, 2, 1, "user", "y", 1.0), (50, 3, 2, "user", "below a circle", 1.0)]
    rows += [(60, m, m - 1 if m else None, "user", str(m), 1.0) for m in range(150)]
    frame = spark.createDataFrame(rows, MESSAGES)
    read = chat.read_back(chat.format_trees(frame, branches=3)).collect()
    assert {(r["conv_id"], r["branch"], tuple(zip(r["roles"], r["texts"]))) for r in read} == plain_paths(rows, 3)
    for r in read:
        assert r["learnt"] == [t for role, t in zip(r["roles"], r["texts"]) if role == "assistant"]
    assert chat.format_trees(frame.limit(0)).count() == 0


def test_chains_of_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None), (None, 0, "user", "z"), (2, 5, None, "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = {r["conv_id"]: (r["roles"], r["texts"]) for r in chat.read_back(chat.format_trees(chat.chains(frame))).collect()}
    assert read == {1: (["system", "user", "user"], ["", "a", "a"]), 2: ([""], ["b"])}


# Link graph


def plain_ranks(seeds, edges, s):
    rank = {h: (1 - s.damping) / len(seeds) for h in seeds}
    for _ in range(s.rounds):
        new = defaultdict(float, {h: (1 - s.damping) / len(seeds) for h in seeds})
        for h, r in rank.items():
            to = [b for a, b in edges if a == h]
            for b in to:
                new[b] += s.damping * r / len(to)
        rank = new
    return rank


def test_link_graph_equals_brute_force(spark):
    rng = random.Random(2)
    hosts = [f"h{i}.org" for i in range(20)] + ["spam.bad.net", "bad.org"]
    pages, edges = [], set()
    for i in range(120):
        src, to = rng.choice(hosts), rng.choices(hosts, k=3)
        edges |= {(src, t) for t in to if t != src}
        pages.append((i, f"HTTPS://{src.upper()}/ok/{i}" if src == "h3.org" else f"http://{src}/{i}?q=://x/", "".join(f'<a href="//{t}/p">x</a><a href="/own">y</a>' for t in to), "clash"))
    pages += [pages[0], (200, None, None, ""), (201, "no scheme", "", ""), (202, "http://", "<a href=>", ""), (203, "x://H3.org#/ok/", None, "")]
    rules = [urlgraph.Rule("h3.org", "/ok/", "allow"), urlgraph.Rule("org", "/7", "block"), urlgraph.Rule("h1.org", "/7", "allow")]
    rules += [urlgraph.Rule("bad.net", "/", "block"), urlgraph.Rule("bad.org", "/", "block")]
    s = urlgraph.Settings(rounds=6, tolerance=0, threshold=0.4)
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, trust string")
    got = {r["page_id"]: r for r in urlgraph.judge(frame, rules, s).collect()}
    bad = {h for h in hosts if "bad" in h.split(".")}
    named = {i: (got[i]["host"], got[i]["path"]) for i in got}
    assert {named[i][0] for i, r in got.items() if r["rule"] is None and r["verdict"] == "block"} - bad
    good = {h for i, (h, p) in named.items() if (h == "h3.org" and p.startswith("/ok/")) or (h == "h1.org" and p.startswith("/7"))} - bad
    present = {h for h, _ in named.values()}
    trust, distrust = plain_ranks(good, edges, s), plain_ranks(bad & present, {(b, a) for a, b in edges}, s)
    for i, r in got.items():
        assert np.isclose(r["trust"], trust.get(r["host"], 0)) and np.isclose(r["distrust"], distrust.get(r["host"], 0))
        if r["rule"] is None:
            t, d = trust.get(r["host"], 0), distrust.get(r["host"], 0)
            assert r["verdict"] == ("block" if d > 0 and d >= s.threshold * (t + d) else "allow")
    assert named[200] == named[201] == ("", "") and named[202] == ("", "") and named[203] == ("h3.org", "")
    assert got[7]["rule"] in ("h1.org/7", "org/7", None) and urlgraph.judge(frame.limit(0), rules, s).count() == 0
    judged = urlgraph.judge(frame, rules, s).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(repr, map(tuple, judged))) == sorted(map(repr, in_duck(urlgraph.oracle(rules, s), pages=frame.toPandas())))


def in_duck(sql, **tables):
    con = pytest.importorskip("duckdb").connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return con.sql(sql).fetchall()


def test_distrust_reaches_the_end_of_a_chain(spark):
    """A farm of 14 hosts, each linking to the next, ends at a blocked one; ten links from it distrust still counts."""
    pages = [(i, f"http://c{i}.org/x", f"<a href='http://c{i + 1}.org/'>") for i in range(14)] + [(14, "http://c14.org/bad/", ""), (15, "http://free.org/", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = urlgraph.judge(frame, [urlgraph.Rule("c14.org", "/bad", "block")]).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {**dict.fromkeys(range(15), "block"), 15: "allow"}


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(data):
        if file.endswith(".parquet"):
            con.execute(f"create view {file[:-8]} as select * from '{data}/{file}'")
    ours, sql = llm_queries.queries()[name](spark, data), con.sql(llm_queries.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(sql.columns)
    places = [sql.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in ours.collect()) == sorted(repr(tuple(r[k] for k in places)) for r in sql.fetchall())


# Pipeline


def test_stages_keep_the_columns_of_documents(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and 0 < out.count() <= before
            docs, before = out, out.count()
    packed = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toPandas()
    assert sorted(packed.doc_id) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert (packed["sum(length)"] == packed["max(doc_tokens)"]).all()


def test_pipeline_of_odd_documents(spark, data, tmp_path):
    os.makedirs(tmp_path / "sf")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-1, "", "en", "s", 0)], docs.schema)
    docs.limit(60).unionByName(odd).write.parquet(str(tmp_path / "sf/documents.parquet"))
    spark.read.parquet(f"{data}/labels.parquet").write.parquet(str(tmp_path / "sf/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "sf")).count() > 0
