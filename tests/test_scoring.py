from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgermill.operators import autoencoder, communities, evaluate, explain, feedback, forest, fusion, graph, moves, scaling, views
from ledgermill.plans import batch, catalog
from ledgermill.settings import DEFAULTS, FEATURES
from ledgermill.sources import fixtures, readers, sinks, synth


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(0)
    rows = [(f"entity_{i:03d}", *[float(x) for x in rng.normal(10, 1, len(FEATURES))]) for i in range(120)]
    rows[7] = (rows[7][0], *[40.0] * len(FEATURES))
    return spark.createDataFrame(rows, "entity_id string, " + ", ".join(f"{f} double" for f in FEATURES)).cache()


def test_forest_ranks_the_outlier_first_whatever_the_partitions(features):
    one = {r.entity_id: r.isolation_forest_score for r in forest.scores(features, trees=60).collect()}
    two = {r.entity_id: r.isolation_forest_score for r in forest.scores(features.repartition(7), trees=60).collect()}
    assert one == pytest.approx(two)
    assert max(one, key=one.get) == "entity_007"
    assert min(one.values()) == 0 and max(one.values()) == pytest.approx(1)


def _conditional(tree, x, known, node=0):
    f = tree.feature[node]
    if f < 0:
        return tree.depth[node]
    left, right = int(tree.left[node]), int(tree.right[node])
    if f in known:
        return _conditional(tree, x, known, left if x[f] < tree.cut[node] else right)
    return sum(tree.size[c] * _conditional(tree, x, known, c) for c in (left, right)) / tree.size[node]


def test_attributions_like_all_orders_and_they_add_up():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    tree = forest.grow(x, rng)
    for row in x[:5]:
        want = np.zeros(3)
        for order in permutations(range(3)):
            for k, f in enumerate(order):
                want[f] += (_conditional(tree, row, set(order[: k + 1])) - _conditional(tree, row, set(order[:k]))) / 6
        assert forest._tree_shap(tree, row) == pytest.approx(want)
        assert want.sum() == pytest.approx(_conditional(tree, row, {0, 1, 2}) - _conditional(tree, row, set()))


def test_autoencoder_learns(features):
    scaled = scaling.standardized(features, list(FEATURES))
    _, losses = autoencoder.train(scaled, epochs=12, rate=0.02)
    assert losses[-1] < losses[0]
    got = {r.entity_id: r.autoencoder_score for r in autoencoder.scores(features, epochs=5).collect()}
    assert max(got, key=got.get) == "entity_007"
    assert all(0 <= v <= 1 for v in got.values())


def test_gradients():
    net = autoencoder.Network.fresh(4, 6, 1)
    x = np.random.default_rng(1).normal(size=(9, 4))
    g, loss = net.gradients(x)
    flat = net.flat()
    for k in range(0, len(flat), 7):
        moved = flat.copy()
        moved[k] += 1e-6
        net.load(moved)
        assert (net.gradients(x)[1] - loss) / 1e-6 == pytest.approx(g[k], abs=1e-3)
        net.load(flat)


def test_louvain_needs_few_tables(spark, monkeypatch):
    """Each table is a pass over all edges or nodes."""
    written, real = [], communities.materialize
    monkeypatch.setattr(communities, "materialize", lambda df: written.append(df.columns) or real(df))
    pairs = real(graph.simple_projection(graph.edges(fixtures.clean_tx(spark, "/root/testdata/sf0.001"))))
    found = real(communities.louvain(pairs))
    assert len(written) < 60
    assert communities.modularity(pairs.withColumn("w", F.lit(1.0)), found) > 0.6
    names = found.groupBy("community").agg(F.min("id").alias("least")).where("community <> least")
    assert names.isEmpty() and found.count() == found.select("id").distinct().count()


def test_louvain_in_blocks_makes_the_moves_of_one_task(spark, monkeypatch):
    """Neither way writes a table for each round of a small graph, and repeated edges do not count twice."""
    written, real = [], moves.materialize
    monkeypatch.setattr(moves, "materialize", lambda df: written.append(df.columns) or real(df))
    tx = fixtures.clean_tx(spark, "/root/testdata/sf0.001")
    simple, repeated = real(graph.simple_projection(graph.edges(tx))), graph.edges(tx).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    alone = sorted(map(tuple, communities.louvain(simple).collect()))
    assert len(written) == 1
    assert alone == sorted(map(tuple, communities.louvain(repeated).collect()))
    monkeypatch.setattr(moves, "FEW_EDGES", 500)
    monkeypatch.setattr(moves, "BLOCK_EDGES", 2_000)
    assert alone == sorted(map(tuple, communities.louvain(simple).collect()))
    assert len(written) > 10


def test_louvain_turns_are_those_of_spark(spark):
    keys = spark.range(100).select(F.xxhash64("id").alias("k"))
    for r in (0, 1, 6):
        rows = keys.select("k", (F.pmod(F.xxhash64(F.lit(42 + r // 2), "k"), F.lit(2)) == r % 2).alias("turn")).toPandas()
        assert list(moves.turns(rows.k.to_numpy(), 42, r)) == list(rows.turn)


def test_louvain_keys_are_of_one_node_each(spark, monkeypatch):
    """Where two nodes share a key, all keys are drawn anew."""
    seeds, real = [], F.xxhash64
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "a string, b string, w double")
    monkeypatch.setattr(communities.F, "xxhash64", lambda seed, c: F.lit(0).cast("long") if not seeds and not seeds.append(1) else real(seed, c))
    keyed, nodes = communities._numbered(edges, 42)
    assert nodes.select("key").distinct().count() == 3
    assert keyed.join(nodes, keyed.a == nodes.key).count() == 2


def test_louvain_finds_cliques(spark):
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "abc" for i in range(6) for j in range(i + 1, 6)] + [("a0", "b0"), ("b1", "c0")]
    found = communities.louvain(spark.createDataFrame(pairs, "a string, b string"))
    groups = {}
    for r in found.collect():
        groups.setdefault(r.community, set()).add(r.id[0])
    assert sorted(map(sorted, groups.values())) == [["a"], ["b"], ["c"]]
    edges = spark.createDataFrame([(*p, 1.0) for p in pairs], "a string, b string, w double")
    assert communities.modularity(edges, found) > 0.5


def test_isolation_is_the_largest_over_wallets(spark):
    entities = spark.createDataFrame([("w1", "E"), ("w2", "E"), ("w3", "F"), ("w4", "G")], "wallet string, entity_id string")
    where = spark.createDataFrame([("Wallet:w1", "x"), ("Wallet:w2", "y"), ("Wallet:w3", "y"), ("IP:1", "y")], "id string, community string")
    got = {r.entity_id: r.community_isolation_score for r in communities.entity_isolation(entities, where).collect()}
    assert got["E"] == pytest.approx(1) and got["G"] == pytest.approx(1) and got["F"] == 0


def score_table(spark, name, **values):
    return spark.createDataFrame(list(values.items()), f"entity_id string, {name} double")


def test_fusion_shares_out_missing_weights_and_ranks(spark):
    scores = {"isolation_forest_score": score_table(spark, "isolation_forest_score", a=1.0, b=0.5), "motif_score": score_table(spark, "motif_score", a=1.0, c=1.0)}
    got = {r.entity_id: r for r in fusion.fuse(scores).collect()}
    assert got["a"].risk_score == pytest.approx(1.0) and got["a"].rank == 1 and got["a"].is_alert
    assert got["c"].risk_score == pytest.approx(0.30 / 0.65)
    assert [got[k].rank for k in "acb"] == [1, 2, 3]


def test_positive_weights():
    assert fusion.positive_weights({"a": 2.0, "b": -1.0, "c": 2.0}) == {"a": 0.5, "b": 0.0, "c": 0.5}
    assert fusion.positive_weights({"a": -1.0}) == {"a": 0.0}


def test_ensemble_ranking_is_that_of_its_own_scores(spark):
    rows = catalog.ensemble_ranking(spark, "/root/testdata/sf0.001").collect()
    scores = {"isolation_forest_score": 0.35, "autoencoder_score": 0.35, "motif_score": 0.30}
    for r in rows:
        assert r.risk_score == pytest.approx(sum(w * r[c] for c, w in scores.items()))
        assert r.is_alert == (r.risk_score >= 0.6)
        assert 0 <= r.community_isolation_score <= 1
    order = sorted(rows, key=lambda r: (-r.risk_score, r.entity_id))
    assert [r["rank"] for r in order] == list(range(1, len(rows) + 1))
    assert len({r.entity_id for r in rows}) == len(rows) == catalog.features(spark, "/root/testdata/sf0.001").count()
    assert max(r.community_isolation_score for r in rows) == pytest.approx(1)
    assert {"country", "city", "latitude", "longitude", "distinct_country_count", "motif_reasons"} <= set(rows[0].asDict())


def test_feedback_of_many_writers_and_compactions(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = lambda names, label, second: spark.createDataFrame([(n, label, "a\nb, \"c\"", f"2026-01-01T00:00:{second:02d}") for n in names], readers.FEEDBACK)
    shared = ["x", "y"]
    sinks.append_feedback(rows(shared, 0, 5), log)
    sinks.append_feedback(rows(shared, 1, 5), log)  # the same second: the later append wins
    sinks.append_feedback(rows(["x"], 0, 1), log)  # an older label does not

    def write(k):
        for j in range(3):
            sinks.append_feedback(rows([f"w{k}-{j}"], k % 2, j), log)

    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(write, k) for k in range(2)] + [pool.submit(feedback.compact, spark, log) for _ in range(2)]
        for job in jobs:
            job.result()
    want = {"x": 1, "y": 1} | {f"w{k}-{j}": k % 2 for k in range(2) for j in range(3)}
    for _ in range(3):
        found = feedback.latest(readers.read_feedback(spark, log)).collect()
        assert {r.entity_id: r.label for r in found} == want
        assert {r.note for r in found} == {"a\nb, \"c\""}
        feedback.compact(spark, log)
    assert len(readers.feedback_batches(spark, log)[0]) == 1
    assert readers.read_feedback(spark, log).count() == len(want)
    (tmp_path / "log" / "batch=9-lost").mkdir()  # a writer that was lost leaves no _SUCCESS
    (tmp_path / "log" / "batch=9-lost" / "part-0.csv").write_text("entity_id,label,note,timestamp,seq\nlost,1,,2027,1\n")
    assert readers.read_feedback(spark, log).count() == len(want)
    (tmp_path / "log" / "old.csv").write_text("label,entity_id,timestamp\n1,old,2025-01-01\n0,x,2027-01-01\n")
    found = {r.entity_id: r.label for r in feedback.latest(readers.read_feedback(spark, log)).collect()}
    assert found == want | {"old": 1, "x": 0}
    feedback.compact(spark, str(tmp_path / "absent"))


def test_feedback_loop(spark, tmp_path):
    log = str(tmp_path / "feedback.csv")
    assert readers.read_feedback(spark, log).count() == 0
    values = {f"e{i}": i / 10 for i in range(10)}
    scores = {"isolation_forest_score": score_table(spark, "isolation_forest_score", **values), "motif_score": score_table(spark, "motif_score", **{k: 1 - v for k, v in values.items()})}
    assert feedback.retrain(scores, readers.read_feedback(spark, log)) is None
    sinks.append_feedback(spark.createDataFrame([(f"e{i}", int(i >= 5), "a, \"b\"", f"2026-01-01T00:00:0{i}") for i in range(10)], readers.FEEDBACK), log)
    feedback.record(spark, log, "e0", False, "again")
    rows = readers.read_feedback(spark, log)
    assert rows.count() == 11
    assert feedback.latest(rows).count() == 10
    path = str(tmp_path / "weights.json")
    weights = feedback.retrain(scores, rows, path)
    assert weights == pytest.approx({"isolation_forest_score": 1.0, "motif_score": 0.0})
    assert readers.read_weights(spark, path) == pytest.approx(weights)
    assert json.loads((tmp_path / "weights.json").read_text())["n_feedback_examples"] == 10
    one_class = rows.where("label = 1")
    assert feedback.retrain(scores, one_class) is None


def test_evaluation(spark):
    ranked = spark.createDataFrame([("a", 1, True), ("b", 2, True), ("c", 3, False)], "entity_id string, rank long, is_alert boolean")
    truth = spark.createDataFrame([("a", True, "peel_chain"), ("c", True, "peel_chain")], "entity_id string, is_illicit boolean, typology string")
    doc = evaluate.report(ranked, truth)
    assert (doc["true_positives"], doc["false_positives"], doc["false_negatives"]) == (1, 1, 1)
    assert doc["precision"] == doc["recall"] == doc["f1"] == 0.5
    assert doc["precision_at_k"]["10"] == 0.6667
    assert doc["recall_by_typology"] == {"peel_chain": 0.5}
    assert "| Precision | 0.500 |" in evaluate.markdown(doc)


def test_sentences(spark):
    row = spark.createDataFrame([("peel_chain, fan_pattern", 6, 9, 150.0), ("none", 1, 1, 7200.0)], "motif_reasons string, distinct_ip_count int, tx_count int, round_trip_time_mean double")
    from pyspark.sql import functions as F

    top = explain.top_features(F.create_map(F.lit("x"), F.lit(-2.0), F.lit("y"), F.lit(0.5)), 2)
    got = [r[0] for r in row.select(explain.sentence(top)).collect()]
    assert got[0] == "Flagged: 6 distinct broadcast IP(s) across 9 transactions, funds moved onward in ~2.5 minutes on average — consistent with a peel chain, fan pattern typology. Top contributing features: x (-2.00), y (+0.50)."
    assert got[1].startswith("Flagged: 1 distinct broadcast IP(s) across 1 transactions. Top")


def test_whole_run_on_synthetic_data(spark, tmp_path):
    tx, truth = synth.generate(spark)
    assert truth.count() == 450
    assert 1215 <= tx.count() <= 5750
    folder = str(tmp_path / "data")
    sinks.write_transactions(tx, truth, folder)
    out = str(tmp_path / "out")
    quick = {"isolation_forest_score": lambda f: forest.scores(f, trees=40), "autoencoder_score": lambda f: autoencoder.scores(f, epochs=3)}
    clean, rejected = batch.ingest(spark, [f"{folder}/transactions.csv"])
    assert rejected.count() == 0 and clean.count() == tx.count()
    done = batch.analyse(clean, rejected, detectors=quick)
    ranked = done.ranked.cache()
    assert set(FEATURES) < set(ranked.columns) and "community_isolation_score" in ranked.columns
    assert sorted(r["rank"] for r in ranked.select("rank").collect()) == list(range(1, ranked.count() + 1))
    sinks.write_ranked(ranked, out)
    done.entities.write.parquet(f"{out}/entities.parquet")
    doc = batch.evaluate_run(spark, out, f"{folder}/ground_truth.csv")
    assert doc["recall_by_typology"]["mixer_fan_in_out"] > 0.5
    assert (tmp_path / "out" / "evaluation_report.md").exists()
    assert "none" in {r.typology for r in views.typologies(ranked).collect()}
    nodes, edges = explain.evidence(done.vertices, done.edges, spark.createDataFrame([(tx.first().src_wallet,)], "wallet string"))
    assert nodes.where("hop = 0").count() == 1 and edges.count() >= 1
    assert views.of_kinds(nodes, edges, ["Wallet"])[1].count() == 0


def test_forest_depth_constant():
    assert forest.average_path(2) == 1.0
    assert forest.average_path(256) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)
    tree = forest.grow(np.ones((5, 2)), np.random.default_rng(0))
    assert tree.paths(np.ones((2, 2))).tolist() == [forest.average_path(5)] * 2
    assert isinstance(pd.DataFrame(), pd.DataFrame)


def test_graph_counts(spark):
    from tests.test_entities import transfers

    tx = transfers(spark, ("A", "B", 1, 0, "1"), ("B", "A", 2, 5, "1"))
    assert graph.edges(tx).count() == 8
    assert graph.vertices(tx).count() == 6
    assert graph.wallet_transactions(graph.edges(tx), spark.createDataFrame([("A",)], "wallet string")).count() == 2


def test_shap_top_has_the_settings_of_the_scores(monkeypatch):
    seen = {}
    for name in ("features", "checkpoint", "_ranking"):
        monkeypatch.setattr(catalog, name, lambda *_: None)
    monkeypatch.setattr(forest, "fit", lambda f, trees=DEFAULTS.forest_trees, **_: trees)
    monkeypatch.setattr(forest, "explain", lambda f, ranked, model, top_n=DEFAULTS.explained_top: seen.update(trees=model, top_n=top_n))
    catalog.shap_top(None, "")
    assert seen == {"trees": DEFAULTS.forest_trees, "top_n": DEFAULTS.explained_top}


def test_ranks_of_tied_scores_are_split(spark):
    rows = [(f"e{k:03d}", float(k % 3 == 0)) for k in range(200)]
    frame = spark.createDataFrame(rows, "entity_id string, s double")
    got = {r.entity_id: r["rank"] for r in fusion.ranked_by(frame, "s", rows_a_part=30).collect()}
    assert got == {e: i + 1 for i, (_, e) in enumerate(sorted((-s, e) for e, s in rows))}


def test_autoencoder_trains_on_blocks_written_once(spark, features, monkeypatch):
    written, real = [], autoencoder.materialize
    monkeypatch.setattr(autoencoder, "materialize", lambda df: written.append(df.columns) or real(df))
    net, losses = autoencoder.train(features, epochs=3)
    assert written == [["n", "block"]]
    x, first = features.select(*FEATURES).toPandas().to_numpy(float), autoencoder.Network.fresh(len(FEATURES), DEFAULTS.autoencoder_hidden, DEFAULTS.seed)
    assert losses[0] == pytest.approx(first.errors(x).mean()) and len(losses) == 3
