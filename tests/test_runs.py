"""Pairs, splits, registries, thresholds, comparisons and whole runs on small cases and against plain Python."""

import itertools
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from namewell import pipeline
from namewell.operators import compare, core, graph, metrics, pairs, registry, splits, tables
from namewell.sources import sinks


def people(spark, n=60, blocks=4, seed=1):
    r = random.Random(seed)
    rows = [(f"p{i:03}::0", f"b{r.randrange(blocks)}", f"p{i // 2:03}" if i % 9 == 0 else f"p{i:03}", 0, f"o{r.randrange(20)}" if i % 7 else "") for i in range(n)]
    return spark.createDataFrame(rows, "mention_id string, block_key string, bibcode string, author_idx long, orcid string")


@pytest.mark.parametrize("salt", [4000, 3])
def test_pairs_against_loops(spark, salt):
    m = people(spark)
    rows = m.collect()
    want = {}
    for a, b in itertools.combinations(sorted(rows), 2):
        if a["block_key"] == b["block_key"] and a["bibcode"] != b["bibcode"]:
            want[f"{a['mention_id']}__{b['mention_id']}"] = int(a["orcid"] == b["orcid"]) if a["orcid"] and b["orcid"] else None
    got = pairs.candidate_pairs(m, ["orcid"], salt_block=salt).collect()
    assert len(got) == len(want) and {r["pair_id"]: r["label"] for r in got} == want
    assert pairs.candidate_pairs(m, ["orcid"], labeled_only=True, salt_block=salt).count() == sum(x is not None for x in want.values())


@pytest.mark.parametrize("salt", [4000, 2])
def test_pair_counts_make_no_pair(spark, salt):
    """What is said of pairs by their mentions' values is counted without them, and is the same."""
    m = people(spark).withColumn("split", F.expr("case when orcid <> '' then substr(orcid, 2, 1) end"))
    m = m.unionByName(m.limit(9).withColumn("bibcode", F.lit("")).withColumn("mention_id", F.concat(F.lit("x"), "mention_id")))
    made = pairs.pair_counts(m, ["split"], salt_block=salt)
    key = lambda r: (r["block_key"], *sorted((r["split_1"], r["split_2"]), key=str))
    want: dict = {}
    for r in pairs.candidate_pairs(m, ["split"], with_id=False).collect():
        want[key(r)] = want.get(key(r), 0) + 1
    rows = made.collect()
    assert {key(r): r["n"] for r in rows} == want and len(rows) == len(want)


def test_pairs_of_one_publication_meet_in_it(spark):
    m = people(spark, blocks=1)
    rows = sorted(m.collect())
    made = pairs.candidate_pairs(m, [], same_bibcode=True)
    want = {f"{a['mention_id']}__{b['mention_id']}" for a, b in itertools.combinations(rows, 2) if a["block_key"] == b["block_key"] and a["bibcode"] == b["bibcode"]}
    assert {r["pair_id"] for r in made.collect()} == want != set()
    join = next(x for x in made._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x)
    assert "bibcode" in join.split("Inner")[0]


def test_pair_ranks():
    for n in (2, 3, 7, 40):
        i, j = pairs.pair_at(np.arange(pairs.pair_count(n)), n)
        assert list(zip(i.tolist(), j.tolist())) == list(itertools.combinations(range(n), 2))


def test_capped_pairs(spark):
    m = people(spark, 80, 3)
    got = pairs.capped_pairs(m, 40)
    again = pairs.capped_pairs(m.repartition(5), 40)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, again.collect())) and len(set(rows)) == len(rows)
    for block in {r["block_key"] for r in m.collect()}:
        ids = sorted(r["mention_id"] for r in m.collect() if r["block_key"] == block)
        n = len(ids)
        ranks = range(pairs.pair_count(n)) if pairs.pair_count(n) <= 40 else np.random.default_rng(pairs.block_seed(11, block)).choice(pairs.pair_count(n), 40, replace=False)
        every = list(itertools.combinations(ids, 2))
        assert sorted((block, *every[k]) for k in ranks) == [r for r in rows if r[0] == block]


def test_capped_pairs_are_not_broadcast(spark, monkeypatch):
    """Neither the blocks, where they are many, nor their drawn pairs go through the driver, however small the planner takes them for."""
    m = people(spark, 80, 3)
    want = sorted(map(tuple, pairs.capped_pairs(m, 40).collect()))
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 100)
    made = pairs.capped_pairs(m, 40)
    plan = made._jdf.queryExecution().executedPlan().toString()
    # the one left is of a number a partition
    assert plan.count("SortMergeJoin") == 7 and all("_part" in x for x in plan.split("\n") if "BroadcastHashJoin" in x), plan
    assert sorted(map(tuple, made.collect())) == want


def test_balance_and_shards(spark, tmp_path):
    df = spark.createDataFrame([(f"x{i}", 1 if i % 5 else 0) for i in range(100)] + [("n", None)], "pair_id string, label int")
    assert {r["label"]: r["count"] for r in pairs.balance(df).groupBy("label").count().collect()} == {0: 20, 1: 20}
    dealt = pairs.shards([("a", 100), ("b", 10), ("c", 9), ("d", 1)], 2)
    assert dealt[0] == ["a"] and sorted(dealt[1]) == ["b", "c", "d"]
    with pytest.raises(ValueError):
        pairs.written_pairs(df.where("false"), f"{tmp_path}/p")


@pytest.mark.parametrize("cuts", [[0, 10], [37, 61], [1000], [5, 5, 300]])
def test_rank_groups(spark, cuts):
    rows = [(f"{i % 250:04x}" + "f" * (i % 3), i) for i in range(300)]
    df = spark.createDataFrame(rows, "d string, i long")
    got = {r["i"]: r["g"] for r in tables.rank_groups(df, F.col("d"), F.col("i"), cuts, "g").collect()}
    want = {i: sum(c <= k for c in cuts) for k, (_, i) in enumerate(sorted(rows))}
    assert got == want


def test_ranked(spark):
    df = spark.createDataFrame([(i * 37 % 501, "x") for i in range(501)], "a long, b string").repartition(7)
    assert sorted((r["a"], r["ord"]) for r in tables.ranked(df, ["a"]).collect()) == [(i, i) for i in range(501)]


def test_splits(spark):
    m = people(spark, 300, 3).where("orcid <> ''")
    made, meta = splits.assign_splits(m, min_neg_val=5, min_neg_test=5, attempts=5)
    assert meta["status"] == "ok" and splits.leaks(made).isEmpty() and made.count() == m.count()
    n = {r["split"]: r["n"] for r in made.groupBy("split").agg(F.count_distinct("orcid").alias("n")).collect()}
    assert n == {"train": 12, "val": 4, "test": 4}
    counts = meta["split_label_counts"]["val"]
    rows = [r for r in made.collect() if r["split"] == "val"]
    both = [(a, b) for a, b in itertools.combinations(rows, 2) if a["block_key"] == b["block_key"]]
    assert (counts["pos"], counts["labeled_pairs"]) == (sum(a["orcid"] == b["orcid"] for a, b in both), len(both))
    assert splits.assign_splits(m, min_neg_val=10**6)[1]["status"] == "split_balance_infeasible"
    few = m.where("orcid in ('o1', 'o2', 'o3', 'o4', 'o5')")
    assert splits.assign_splits(few, min_neg_val=1200, min_neg_test=1)[1]["status"] in ("split_balance_degraded", "split_balance_infeasible")
    assert splits.assign_splits(m.drop("orcid"))[1]["status"] == "no_orcid_column" and splits.assign_splits(m.withColumn("orcid", F.lit(" ")))[1]["status"] == "no_known_orcid"
    with pytest.raises(ValueError):
        splits.assign_splits(m, train=0.9, val=0.2)


def test_subset(spark):
    m = people(spark, 400, 60, 3)
    one = splits.stage_subset(m, 90, 5)
    ids = sorted(r["mention_id"] for r in one.collect())
    assert len(ids) == 90 == len(set(ids)) and ids == sorted(r["mention_id"] for r in splits.stage_subset(m.repartition(6), 90, 5).collect())
    assert ids != sorted(r["mention_id"] for r in splits.stage_subset(m, 90, 6).collect())
    assert splits.stage_subset(m, 10**6).count() == 400 == splits.stage_subset(m, None).count()
    sizes = splits.subset_summary(one).first()
    # 45 blocks of two at least: rich in pairs
    assert sizes["pairs"] >= 45 and splits.cached_subset_problems(one, 90, "smoke", 5) == []
    assert splits.cached_subset_problems(one, 80, "mini", 5) == ["made for another stage or seed", "more mentions than asked for"]
    assert splits.manifest(one).columns[-1] == "subset_seed" and splits.pair_upper_bound([1, 4, 5], 8) == 14


def test_registry_keeps_merges_and_aliases(spark, tmp_path):
    frame = lambda d: spark.createDataFrame(list(d.items()), "mention_id string, author_uid string")
    named = lambda df: {r["mention_id"]: r["author_uid"] for r in df.collect()}
    first, kept, meta = registry.assign(frame({"a": "x", "b": "x", "c": "y", "d": "z"}), registry.load(spark, None, "ns"), "ns")
    assert named(first) == {"a": "ns::au000000001", "b": "ns::au000000001", "c": "ns::au000000002", "d": "ns::au000000003"} and meta["clusters_new"] == 3
    again, same, meta = registry.assign(frame({"a": "p", "c": "q"}), kept, "ns")
    assert named(again) == {"a": "ns::au000000001", "c": "ns::au000000002"} and same[2] == kept[2] == 4 and meta["clusters_reused"] == 2
    merged, after, meta = registry.assign(frame({"b": "m", "c": "m", "e": "m", "f": "n"}), same, "ns")
    assert named(merged) == dict.fromkeys("bce", "ns::au000000001") | {"f": "ns::au000000004"}
    assert meta["clusters_merged_conflicts"] == 1 and [tuple(r) for r in after[1].collect()] == [("ns::au000000002", "ns::au000000001")]
    # a chain: 1 and 3 become one, and 2, an alias of 1, follows
    chain, last, _ = registry.assign(frame({"a": "w", "d": "w"}), after, "ns")
    assert set(named(chain).values()) == {"ns::au000000001"} and {tuple(r) for r in last[1].collect()} == {("ns::au000000002", "ns::au000000001"), ("ns::au000000003", "ns::au000000001")}
    back = registry.load(spark, registry.save(last, f"file://{tmp_path}/r", "ns"), "ns")
    assert named(registry.assign(frame({"c": "k", "d": "l"}), back, "ns")[0]) == {"c": "ns::au000000001", "d": "ns::au000000001"}
    with pytest.raises(ValueError):
        registry.load(spark, f"file://{tmp_path}/r", "other")
    with pytest.raises(ValueError):
        registry.assign(frame({"a": "x"}).unionByName(frame({"a": "y"})), kept, "ns")


def plain_threshold(sim, y):
    best = None
    for g in range(2001):
        hit = [s >= g / 1000 - 1 - 1e-9 for s in sim]
        tp, fp = sum(h and a for h, a in zip(hit, y)), sum(h and not a for h, a in zip(hit, y))
        f1 = 2 * tp / (tp + fp + sum(y)) if tp else 0.0
        best = max(best or (-1,), (round(f1, 12), min(g, 2000 - g), g))
    return best[2] / 1000 - 1, best[0]


def test_best_threshold(spark):
    r = random.Random(4)
    cases = [([0.9, -0.9], [True, False]), ([round(r.uniform(-1, 1), 6) for _ in range(512)], None), ([-1.0, 1.0, 0.3], [False, True, True])]
    for sim, y in cases:
        y = y or [r.random() < (s + 1) / 2 for s in sim]
        got = metrics.best_threshold(spark.createDataFrame(list(zip(sim, y)), "sim double, y boolean")).first()
        want = plain_threshold(sim, y)
        assert abs(got["threshold"] - want[0]) < 1e-9 and abs(got["f1"] - want[1]) < 1e-9 and got["status"] == "ok"
    for rows, status in (([(0.5, False)], "fallback_no_positives"), ([(0.5, True)], "fallback_no_negatives"), ([], "fallback_no_labels")):
        got = metrics.best_threshold(spark.createDataFrame(rows, "sim double, y boolean")).first()
        assert (got["threshold"], got["status"]) == (0.35, status)


def test_eps():
    assert metrics.resolve_eps({"eps_mode": "from_threshold"}, 0.7)[0] == pytest.approx(0.3) and metrics.resolve_eps({"eps_mode": "val_sweep", "eps_fallback": 0.4})[1]["source"] == "val_sweep_fallback"
    assert metrics.resolve_eps({"eps_mode": "val_sweep", "selected_eps": 0.9, "eps_max": 0.5})[0] == 0.5 and metrics.resolve_eps({"eps": -1})[0] == 0
    assert metrics.eps_values() == [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]
    picked = metrics.pick_eps([{"eps": 0.2, "f1": 0.9}, {"eps": 0.3, "f1": 0.9}, {"eps": 0.5, "f1": 0.8}, {"eps": 0.4, "f1": None}], 0.2, 0.5)
    assert (picked["selected_eps"], picked["boundary_hit"], picked["n_valid_candidates"], picked["f1_gap_best_second"]) == (0.3, False, 3, 0.0)
    edge = metrics.pick_eps([{"eps": 0.5, "f1": 0.9}, {"eps": 0.3, "f1": 0.8}], 0.2, 0.5)
    assert edge["boundary_side"] == "max" and metrics.range_limited(edge, [{"eps": 0.6, "f1": 0.91}])["range_limited"] and not metrics.range_limited(edge, [{"eps": 0.6, "f1": 0.901}])["range_limited"]


@pytest.mark.parametrize("most", [10**6, 1])
def test_graph(spark, most):
    r = random.Random(6)
    nodes = [(f"b{i % 3}", i) for i in range(90)] + [("lone", 900)]
    edges = [(f"b{b}", min(i, j), max(i, j)) for b in range(3) for i, j in [(3 * r.randrange(30) + b, 3 * r.randrange(30) + b) for _ in range(22)] if i != j]
    n, e = spark.createDataFrame(nodes, "block_key string, node long"), spark.createDataFrame(edges, "block_key string, src long, dst long")
    parent = {i: i for _, i in nodes}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for _, i, j in edges:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    got = {x["node"]: (x["block_key"], x["label"]) for x in graph.components(n, e, most).collect()}
    roots = {b: sorted({find(i) for c, i in nodes if c == b}) for b in ("b0", "b1", "b2", "lone")}
    assert got == {i: (b, roots[b].index(find(i))) for b, i in nodes}
    dense = {x["node"]: x["label"] for x in graph.dbscan(n, e, 3).collect()}
    near = {i: {i} for _, i in nodes}
    for _, i, j in edges:
        near[i].add(j), near[j].add(i)
    core_nodes = {i for i in near if len(near[i]) >= 3}
    assert dense[900] == 0 and all((dense[i] == -1) == (not near[i] & core_nodes) for i in near if i != 900)
    alone = {x["node"]: (x["block_key"], x["label"]) for x in graph.dbscan(n, e, 3, noise="singletons").collect()}
    assert -1 not in {x for _, x in alone.values()} and len({alone[i] for i in near if dense[i] == -1}) == sum(x == -1 for x in dense.values())


def test_drift(spark):
    frame = lambda rows: spark.createDataFrame(rows, "mention_id string, block_key string, author_uid string")
    old = frame([("m1", "a", "u1"), ("m2", "a", "u2"), ("m3", "b", "u3"), ("gone", "c", "u4")])
    swapped = frame([("m1", "a", "u2"), ("m2", "a", "u1"), ("m3", "b", "u3"), ("gone", "c", "u4")])
    got = compare.drift_summary(old, swapped)
    assert (got["changed_blocks"], got["changed_mentions"]) == (0, 0)
    new = frame([("m1", "a", "u1"), ("m2", "a", "u1"), ("m3", "b", "u3"), ("come", "d", "u9")])
    got = compare.drift_summary(old, new)
    assert (got["changed_blocks"], got["changed_mentions"], got["missing_in_current"], got["missing_in_baseline"], got["total_mentions_compared"]) == (3, 3, 1, 1, 3)
    assert [b["block_key"] for b in got["top_changed_blocks"]] == ["a", "c", "d"] and got["top_changed_blocks"][0]["current_clusters"] == 1
    s = compare.compare_seconds({"a": {"x_seconds": 4.0, "n": 3}, "load_s": 1}, {"a": {"x_seconds": 2.0}, "y_seconds": 1})
    assert s["metrics"]["a.x_seconds"]["speedup"] == 2 and s["baseline_only_metrics"] == ["load_s"] and s["top_regressions"] == [] and s["top_improvements"][0]["metric"] == "a.x_seconds"
    assert compare.compare_figures({"f1": 0.5}, {"f1": 0.75, "n": 1}, ["f1", "n"]) == {"f1": {"baseline": 0.5, "current": 0.75, "delta": 0.25}, "n": {"baseline": None, "current": 1, "delta": None}}


def test_sinks(spark, tmp_path):
    assert sinks.read_report(sinks.write_report({"run_id": "r", "x": 1}, f"{tmp_path}/a/r.json")) == {"run_id": "r", "x": 1}
    assert sinks.consistent("r", [f"{tmp_path}/a/r.json", f"{tmp_path}/none"]) and not sinks.consistent("q", [f"{tmp_path}/a/r.json"])
    assert sinks.read_config(None, {"a": 1}) == {"a": 1} and sinks.read_config(f"{tmp_path}/a/r.json", {})["x"] == 1
    with pytest.raises(FileNotFoundError):
        sinks.read_config(f"{tmp_path}/nope.json", {})
    assert sinks.valid_tag("a-1") == "a-1" and "| 0.500000 |" in sinks.cluster_report([{"v": "x", "f1": 0.5}])
    for bad in ("", "a b", "-x"):
        with pytest.raises(ValueError):
            sinks.valid_tag(bad)
    df = spark.createDataFrame([("a", 1), (None, 2), ("", 3)], "s string, n int")
    one = sinks.fingerprint(df, ["s", "n"]).first()["fingerprint"]
    assert one == sinks.fingerprint(df.orderBy(F.desc("n")).repartition(3), ["s", "n"]).first()["fingerprint"] != sinks.fingerprint(df.na.fill("", ["s"]), ["s", "n"]).first()["fingerprint"]


@pytest.mark.parametrize("kind", ["parquet", "jsonl"])
def test_whole_run(spark, tmp_path, kind):
    """From sources to mirrored sources, in both formats, with a registry that a second run keeps."""
    pubs = [("bib1", ["Doe J", "Roe A"], "Paper 1", 2020, "doi1"), ("bib2", ["Doe J.", " "], "Paper 2", 2021, "doi2"), ("bib4", [], "No authors", 2021, "doi4")]
    refs = [("bib1", ["Doe J", "Roe A"], None, None, "url1"), ("bib3", ["Ref X", "Ref Y"], "Paper 3", 2022, "url3")]
    path = {}
    for name, rows, last in (("pubs", pubs, "DOI"), ("refs", refs, "PDF_URL")):
        df = spark.createDataFrame(rows, f"Bibcode string, Author array<string>, Title string, Year int, {last} string").repartition(2)
        path[name] = f"{tmp_path}/{name}.{kind}"
        (df.write.parquet if kind == "parquet" else df.write.json)(path[name])
    request = lambda i, o: pipeline.Request(publications=path["pubs"], references=path["refs"], output=f"{tmp_path}/out{o}", uid_scope="registry", namespace="ns", registry_in=i, registry_out=f"{tmp_path}/reg{o}")
    seen = []
    report = pipeline.disambiguate(spark, request(None, 1), tell=lambda what, more: seen.append(what))
    assert seen == ["load", "pairs", "cluster", "export", "quality"] and report["metrics"]["mention_coverage"] == 1.0 and report["metrics"]["uid_uniqueness_max"] == 1
    assert report["gates"]["blockers"] == [] and report["load"]["publication"]["rows"] == 2
    read = spark.read.parquet if kind == "parquet" else spark.read.json
    out = {r["Bibcode"]: r for r in read(f"{tmp_path}/out1/publications").collect()}
    assert set(out) == {"bib1", "bib2", "bib4"} and out["bib1"]["DOI"] == "doi1" and [len(out[b]["AuthorUID"]) for b in ("bib1", "bib2", "bib4")] == [2, 1, 0]
    copy = {r["Bibcode"]: r for r in read(f"{tmp_path}/out1/references").collect()}
    assert copy["bib1"]["AuthorUID"] == out["bib1"]["AuthorUID"] and copy["bib3"]["AuthorDisplayName"] == ["Ref X", "Ref Y"]
    kinds = {(r["source_type"], r["bibcode"], r["author_idx"]): r["assignment_kind"] for r in spark.read.parquet(f"{tmp_path}/out1/source_author_assignments").collect()}
    assert len(kinds) == 7 and kinds["reference", "bib1", 0] == "projected_duplicate" and kinds["publication", "bib1", 0] == "canonical"
    again = pipeline.disambiguate(spark, request(f"{tmp_path}/reg1", 2))
    assert again["metrics"]["registry"]["clusters_new"] == 0 and {r["Bibcode"]: r["AuthorUID"] for r in read(f"{tmp_path}/out2/publications").collect()} == {k: v["AuthorUID"] for k, v in out.items()}
    drift = lambda i: spark.read.parquet(f"{tmp_path}/out{i}/mention_clusters").drop("author_uid").withColumnRenamed("author_uid_local", "author_uid")
    assert compare.drift_summary(drift(1), drift(2))["changed_blocks"] == 0
    assert json.loads(spark.read.text(f"{tmp_path}/out1/report").first()[0])["gates"]["go"]


def test_run_refuses(spark, tmp_path):
    for bad in ({"uid_scope": "registry"}, {"uid_scope": "x"}, {"namespace": "a::b"}, {"eps": 1.0}, {"least": 0}):
        with pytest.raises(ValueError):
            pipeline.Request(publications="p", output="o", **bad)
    spark.createDataFrame([("", ["A"]), ("b", [])], "Bibcode string, Author array<string>").write.parquet(f"{tmp_path}/p")
    with pytest.raises(ValueError, match="no mention"):
        pipeline.disambiguate(spark, pipeline.Request(publications=f"{tmp_path}/p", output=f"{tmp_path}/o"))
    # an author without a key would be lost: the run fails when it mirrors
    spark.createDataFrame([("", ["A B"]), ("b", ["C D"])], "Bibcode string, Author array<string>").write.parquet(f"{tmp_path}/q")
    with pytest.raises(ValueError, match="1 rows"):
        pipeline.disambiguate(spark, pipeline.Request(publications=f"{tmp_path}/q", output=f"{tmp_path}/o"))
    assert os.path.exists(f"{tmp_path}/p")


def test_preflight(spark):
    got = metrics.preflight(people(spark), cap=10, budget_bytes=1)
    assert got["n_mentions"] == 60 and got["memory_feasible"] is False and got["pair_upper_bound"] <= 40
    assert core.complete(people(spark), people(spark).select("bibcode").distinct()).count() > 0
