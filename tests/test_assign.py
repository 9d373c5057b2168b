"""Assignments, mirrored rows, quality figures, gates and vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from namewell.operators import assign, gates, metrics, vectors


def test_assignments_and_mirror(spark):
    pos = spark.createDataFrame([("publication", 0, "b1", 0, "Doe J"), ("publication", 0, "b1", 1, "Roe A"), ("reference", 1, "b1", 0, "Doe J.")], "source_type string, source_row_idx long, bibcode string, author_idx long, author_raw string")
    cl = spark.createDataFrame([("b1::0", "blk.0")], "mention_id string, author_uid string")
    own = spark.createDataFrame([("b1", "publication", 0)], "bibcode string, canonical_source_type string, canonical_source_row_idx long")
    out = assign.assignments(pos, cl, own, "set")
    got = sorted((r["source_row_idx"], r["author_idx"], r["author_uid"], r["canonical_mention_id"], r["assignment_kind"]) for r in out.collect())
    assert got == [(0, 0, "set::blk.0", "b1::0", "canonical"), (0, 1, "set::src.publication.0.1", "src::publication::0::1", "fallback_unmatched"), (1, 0, "set::blk.0", "b1::0", "projected_duplicate")]
    entity = {r["author_uid"]: r for r in assign.entities(out).collect()}["set::blk.0"]
    assert (entity["author_display_name"], entity["aliases"], entity["mention_count"], entity["document_count"], entity["unique_mention_count"], entity["author_uid_local"]) == ("Doe J", ["Doe J", "Doe J."], 2, 2, 1, "blk.0")
    raw = spark.createDataFrame([(0, 2, "old"), (1, 1, "old"), (2, 0, "old")], "source_row_idx long, n_authors int, AuthorUID string")
    named = assign.with_display_names(out, assign.entities(out))
    made, figures = assign.mirror(raw, named)
    lists = {r["source_row_idx"]: (r["AuthorUID"], r["AuthorDisplayName"]) for r in made.collect()}
    assert lists[0][1] == ["Doe J", "Roe A"] and lists[1] == (["set::blk.0"], ["Doe J"]) and lists[2] == ([], [])
    assert figures == {"rows_total": 3, "authors_total": 3, "authors_mapped": 3, "authors_unmapped": 0, "authors_fallback": 1, "coverage_rate": 1.0}
    with pytest.raises(ValueError, match="3 rows"):
        assign.mirror(raw.withColumn("n_authors", raw.n_authors + 1), named)
    with pytest.raises(ValueError):
        assign.assignments(pos, cl, own, "a::b")
    with pytest.raises(ValueError, match="two clusters"):
        assign.assignments(pos, cl.unionByName(cl), own)


def test_quality(spark):
    s = spark.createDataFrame([("a", "b", 0.95, 0.05), ("a", "z", 0.9, 0.1), ("a", "c", float("nan"), 3.0)], "mention_id_1 string, mention_id_2 string, cosine_sim double, distance double")
    c = spark.createDataFrame([("a", "k", "u1"), ("b", "k", "u2"), ("c", "k", "u1")], "mention_id string, block_key string, author_uid string")
    r = metrics.cluster_quality(s, c, 0.8).first()
    # NaN sorts over every number in Spark, but it is a missing score here
    assert (r["merged_low_conf_count"], r["cluster_count"], r["singleton_ratio"], r["n_pairs_evaluated"], r["cosine_non_finite_count"], r["distance_above_max_count"], r["pair_score_range_ok"]) == (0, 2, 0.5, 3, 1, 1, False)
    assert r["split_high_sim_count"] == 2 and (r["cosine_min"], r["cosine_max"]) == (0.9, 0.95)
    t = metrics.clamp_counts(s).first()
    assert (t["cosine_non_finite"], t["distance_above"]) == (1, 1)
    assert s.select(metrics.clamped_cosine(F.col("cosine_sim"))).collect()[2][0] == 0 and s.select(metrics.clamped_distance(F.col("distance"))).collect()[2][0] == 2


GOOD = {"stage": "smoke", "schema_valid": True, "determinism_valid": True, "uid_uniqueness_valid": True, "run_id_consistent": True, "mention_coverage": 1.0, "uid_uniqueness_max": 1, "val_class_counts": {"neg": 20}, "test_class_counts": {"neg": 25}, "threshold": 0.3, "threshold_selection_status": "ok"}


@pytest.mark.parametrize("change, blockers, warnings", [
    ({}, [], []),
    ({"schema_valid": False}, ["schema_valid"], []),
    ({"mention_coverage": 0.99}, ["mention_coverage"], []),
    ({"mention_coverage": None, "metric_scope": "train"}, [], []),
    ({"threshold": 0.96}, ["threshold_not_extreme"], []),
    ({"threshold_selection_status": "guessed"}, ["threshold_selection_status"], []),
    ({"val_class_counts": {"neg": 19}}, ["min_negatives_val"], []),
    ({"singleton_ratio": 0.5}, [], ["singleton_ratio"]),
    ({"singleton_ratio": 0.5, "stage": "full", "val_class_counts": {"neg": 500}, "test_class_counts": {"neg": 500}, "train_block_size_p95": 2, "train_pairs": 300_000}, ["singleton_ratio"], []),
    ({"singleton_ratio": 0.5, "stage": "infer_sources"}, [], ["singleton_ratio"]),
    ({"stage": "mid", "val_class_counts": {"neg": 200}, "test_class_counts": {"neg": 200}}, ["train_block_size_p95", "train_pairs"], []),
    ({"split_balance_status": "split_balance_infeasible"}, ["split_balance_status"], []),
    ({"split_balance_status": "split_balance_degraded"}, [], ["split_balance_status"]),
    ({"max_possible_neg_total": 5, "required_neg_total": 6}, ["split_neg_feasible"], []),
    ({"eps_boundary_hit": True}, [], ["eps_boundary_hit"]),
    ({"eps_range_limited": True}, [], ["eps_range_limited"]),
    ({"memory_feasible": False, "pair_score_range_ok": False}, ["memory_feasible"], ["pair_score_range_ok"]),
    ({"uid_local_to_global_valid": False}, ["uid_local_to_global_valid"], []),
    ({"train_pairwise_f1": 0.79}, ["train_pairwise_f1_sanity"], []),
    ({"split_high_sim_rate_probe": 0.21}, [], ["split_high_sim_rate_probe"]),
])
def test_gates(change, blockers, warnings):
    got = gates.evaluate(GOOD | change)
    assert (got["blockers"], got["warnings"], got["go"]) == (blockers, warnings, not blockers)


def test_gates_by_config():
    got = gates.evaluate(GOOD | {"singleton_ratio": 0.2}, {"stages": {"smoke": {"singleton_ratio_max": 0.1, "cluster_quality_severity": "hard"}}})
    assert got["blockers"] == ["singleton_ratio"]
    assert gates.evaluate(GOOD | {"metric_scope": "infer"}, {"infer": {"stages": {"smoke": {"min_neg_val": 21}}}})["blockers"] == ["min_negatives_val"]
    assert len(gates.evaluate(GOOD | {"stage": "mid", "train_pairwise_f1": 1.0})["checks"]) == 22
    assert gates.severity("soft") == "warning" and gates.severity(None) == "blocker" and gates.severity("?", "warning") == "warning"


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string").repartition(3)
    got = {r["text"]: r["vector"] for r in vectors.stub_vectors(df, "t", 8).collect()}
    assert set(got) == {"a", "b"} and np.allclose(got["a"], vectors.stub_vector("a", 8)) and abs(np.linalg.norm(got["b"]) - 1) < 1e-6
    w = {"w1": np.ones((4, 8)), "b1": np.zeros(4), "w2": np.eye(3, 4), "b2": np.array([0, -1, 1])}
    out = vectors.encode(vectors.stub_vectors(df, "t", 8), "text", "vector", w).collect()
    assert all(abs(np.linalg.norm(r["vector"]) - 1) < 1e-6 and len(r["vector"]) == 3 for r in out)
    np.savez(tmp_path / "w.npz", **w)
    assert vectors.load_weights(f"{tmp_path}/w.npz", 3, 5)["w1"].shape == (4, 8)
    with pytest.raises(ValueError):
        vectors.load_weights(f"{tmp_path}/w.npz", 3, 6)
    calls = []
    make = lambda: calls.append(1) or vectors.stub_vectors(df, "t", 8).withColumnRenamed("text", "key")
    for _ in range(2):
        with pytest.warns(UserWarning) if not calls else np.errstate():
            assert vectors.cached(spark, f"{tmp_path}/v", 8, 2, make).count() == 2
    assert len(calls) == 1
    with pytest.warns(UserWarning, match="unusable"):
        vectors.cached(spark, f"{tmp_path}/v", 9, 2, make)
    v = spark.createDataFrame([(1, [1.0])], "canonical_record_id long, vector array<double>")
    with pytest.raises(ValueError, match="2"):
        vectors.with_vectors(spark.createDataFrame([(1, "m"), (2, "n")], "canonical_record_id long, mention_id string"), v)
