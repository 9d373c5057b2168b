"""Scores by tiles against plain numpy, and what is worked out of them without keeping pairs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from namewell.operators import graph, metrics, tiles


def points(spark, n=90, blocks=3, seed=3):
    r = np.random.default_rng(seed)
    rows = [(int(k), f"b{k % blocks}", [float(x) for x in r.standard_normal(4)], int(k % 4) if k % 11 else None) for k in r.permutation(n)]
    rows += [(900, "b0", None, 1), (901, "b0", [0.0] * 4, 1), (902, "b0", [1.0, None, 2.0, 3.0], 1), (903, "b0", [1.0, 2.0], 1), (904, "b0", [2.0, 1.0], 1), (905, "alone", [1.0] * 4, 1), (None, "b1", [1.0] * 4, 1), (906, None, [1.0] * 4, 1), (5, "b2", [1.0] * 4, 2)]
    return spark.createDataFrame(rows, "node long, block_key string, vector array<float>, truth long").repartition(3), rows


def cosines(rows):
    out = {}
    for a, b in itertools.combinations([r for r in rows if r[0] is not None and r[1] is not None], 2):
        if a[1] == b[1] and a[0] != b[0]:
            x, y = (np.array(v[2] if v[2] is not None else [None], float).astype(np.float32).astype(float) for v in sorted((a, b), key=lambda v: v[0]))
            c = float(x @ y / max(np.linalg.norm(x), 1e-8) / max(np.linalg.norm(y), 1e-8)) if len(x) == len(y) else 0.0
            out.setdefault((a[1], min(a[0], b[0]), max(a[0], b[0])), []).append((round(c if np.isfinite(c) else 0.0, 6) + 0.0, a[3], b[3]))
    return out


@pytest.mark.parametrize("tile", [tiles.TILE, 7])
def test_scores_by_tiles(spark, tile):
    df, rows = points(spark)
    want = sorted((*k, *x[:1]) for k, v in cosines(rows).items() for x in v)
    made = tiles.block_scores(df, ["truth"], digits=6, tile=tile, step=5)
    got = made.collect()
    assert sorted(tuple(r)[:4] for r in got) == want
    truth = {r[0]: r[3] for r in rows if r[0] != 5}
    assert all(r["truth_1"] == truth[r["src"]] and r["truth_2"] == truth[r["dst"]] for r in got if 5 not in (r["src"], r["dst"]))
    near = tiles.block_scores(df, digits=6, within=0.6, tile=tile, step=5).where("1 - cosine_sim <= 0.6")
    assert sorted(map(tuple, near.collect())) == [x for x in want if 1 - x[3] <= 0.6]
    # only vectors are shuffled, once for every two tiles: never pairs
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("MapInArrow")[0] and "Exchange" not in plan.split("MapInArrow")[0]


@pytest.mark.parametrize("tile", [tiles.TILE, 7])
def test_counts_by_tiles(spark, tile, monkeypatch):
    monkeypatch.setattr(tiles, "HELD", 50)
    df, rows = points(spark)
    want: dict = {}
    for v in cosines(rows).values():
        for c, a, b in v:
            key = (None if a is None or b is None else a == b, c)
            want[key] = want.get(key, 0) + 1
    got = {(r["truth"], r["cosine_sim"]): r["n"] for r in tiles.score_counts(df, ["truth"], 6, tile=tile, step=5).collect()}
    assert got == want
    bare = {r["truth"]: r["n"] for r in tiles.score_counts(df, ["truth"], tile=tile, step=5).collect()}
    assert bare == {k: sum(n for (t, _), n in want.items() if t == k) for k in (True, False, None)}
    one = tiles.score_counts(df, [], 6, tile=tile).withColumn("distance", 1 - F.col("cosine_sim"))
    every = tiles.block_scores(df, digits=6).withColumn("distance", 1 - F.col("cosine_sim"))
    assert metrics.score_ranges(one, "n").first() == metrics.score_ranges(every).first() and metrics.clamp_counts(one, "n").first() == metrics.clamp_counts(every).first()
    assert tiles.score_counts(df.where("false"), [], 6).count() == 0


@pytest.mark.parametrize("least", [2, 3, 6])
def test_dbscan_of_vectors(spark, least):
    """The clusters of tiles are those of a table of edges."""
    df, _ = points(spark)
    df = df.where("node is not null and block_key is not null and node <> 5")
    edges = graph.edges_within(tiles.block_scores(df, digits=6).withColumn("distance", 1 - F.col("cosine_sim")), F.lit(0.3))
    want = sorted(map(tuple, graph.dbscan(df.select("block_key", "node"), edges, least).collect()))
    assert sorted(map(tuple, graph.block_dbscan(df, 0.3, least, digits=6).collect())) == want and len({x[2] for x in want}) > 2


def test_thinned_edges(spark, monkeypatch):
    """Components need no more edges of a partition than it has nodes, and are the same."""
    r = np.random.default_rng(5)
    rows = [(f"b{k}", int(a), int(b)) for k in range(3) for a, b in r.integers(0, 40, (2000, 2)) if a % 4 == b % 4 and a != b]
    edges = spark.createDataFrame(rows, "block_key string, src long, dst long").repartition(2)
    nodes = spark.range(41).selectExpr("id as node", "explode(array('b0', 'b1', 'b2', 'b3')) as block_key")
    for most in (graph.FOREST, 100):
        monkeypatch.setattr(graph, "FOREST", most)
        less = graph.thinned(edges)
        assert less.count() <= 2 * 3 * 40 < len(rows)
        found = {(x["block_key"], x["node"]): x["label"] for x in graph.components(nodes, edges).collect()}
        assert found == {(f"b{k}", n): (n % 4 if n < 40 else 4) if k < 3 else n for k in range(4) for n in range(41)}


def test_scored_candidates(spark):
    """Pairs are scored where they are made, as ``score_pairs`` does with two joins."""
    from namewell.operators import pairs

    rows = [(f"m{k}", f"b{k % 2}", "" if k % 5 == 0 else f"p{k // 4}", k) for k in range(30)]
    m = spark.createDataFrame(rows, "mention_id string, block_key string, bibcode string, ord long")
    v = spark.createDataFrame([(f"m{k}", [float(k % 3), 1.0, float(k)]) for k in range(28)], "mention_id string, vector array<double>")
    cols = ["block_key", "mention_id_1", "mention_id_2", "ord_1", "ord_2", F.round("cosine_sim", 9), F.round("distance", 9)]
    want = graph.score_pairs(pairs.candidate_pairs(m, [], order="ord", with_id=False), v).select(*cols)
    assert sorted(map(tuple, graph.scored_candidates(m, v, [], "ord").select(*cols).collect())) == sorted(map(tuple, want.collect()))


def test_symmetric_distances(spark):
    df = spark.createDataFrame([("b", 1, 2, 0.5, 3.0), ("b", 4, 3, float("nan"), -1.0), ("b", 5, 5, 1.0, 1.0)], "block_key string, src long, dst long, x double, y double")
    twice = df.selectExpr("block_key", "src", "dst", "x as distance").union(df.selectExpr("block_key", "dst", "src", "y"))
    want = sorted(map(tuple, graph.sanitized(twice).collect()))
    assert sorted(map(tuple, graph.symmetric(df, F.col("x"), F.col("y")).collect())) == want == [("b", 1, 2, 1.25), ("b", 3, 4, 0.5)]


def test_eps_sweep_counts_every_pair(spark):
    df, rows = points(spark)
    df = df.where("node is not null and block_key is not null and node <> 5")
    got = {r["eps"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in graph.eps_sweep(df, [0.05, 0.2], digits=6).collect()}
    known = {r[0]: r for r in rows if r[0] is not None and r[1] is not None and r[0] != 5}
    for eps, counts in got.items():
        edges = graph.edges_within(tiles.block_scores(df, digits=6).withColumn("distance", 1 - F.col("cosine_sim")), F.lit(eps))
        label = {r["node"]: (r["block_key"], r["label"]) for r in graph.components(df.select("block_key", "node"), edges).collect()}
        want = [0, 0, 0, 0]
        for a, b in itertools.combinations(known.values(), 2):
            if a[1] == b[1] and a[3] is not None and b[3] is not None:
                want[2 * (label[a[0]] != label[b[0]]) + (a[3] != b[3])] += 1
        assert counts == tuple(want), (eps, counts, want)
