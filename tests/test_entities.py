from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgermill import session
from ledgermill.functions.temporal import gaps
from ledgermill.operators import enrich, explain, fusion, graph, growing, linkage, motifs
from ledgermill.operators.components import connected_components
from ledgermill.operators.features import entity_features, touches, with_entities, with_linked, with_repeated
from ledgermill.plans import catalog
from ledgermill.sources import fixtures

SCHEMA = "tx_id string, timestamp timestamp_ntz, src_wallet string, dst_wallet string, amount_btc double, broadcast_ip string, asn string"
T0 = datetime(2026, 1, 1)


def transfers(spark, *rows):
    """rows: (src, dst, amount, seconds after T0, ip)."""
    return spark.createDataFrame([(f"t{i:04d}", T0 + timedelta(seconds=s), a, b, float(x), ip, "AS1") for i, (a, b, x, s, ip) in enumerate(rows)], SCHEMA)


def entity_map(spark, *rows, **options):
    return {r.wallet: r.entity_id for r in linkage.wallet_entities(transfers(spark, *rows), **options).collect()}


def test_peel_chain_is_one_entity(spark):
    got = entity_map(spark, ("W0", "W1", 10, 0, "1"), ("W1", "W2", 9, 30, "2"), ("W2", "W3", 8.1, 60, "3"))
    assert len(set(got.values())) == 1 and len(got) == 4


def test_shared_address_links_at_any_time(spark):
    got = entity_map(spark, ("A1", "X", 1, 0, "9.9.9.9"), ("A2", "Y", 1, 4 * 86400, "9.9.9.9"))
    assert got["A1"] == got["A2"] != got["X"]


def test_unrelated_stay_apart(spark):
    got = entity_map(spark, ("A", "B", 1, 0, "1"), ("C", "D", 1, 86400, "2"))
    assert len(set(got.values())) == 4


def test_as_of_boundaries(spark):
    links = lambda *rows: [(r.in_tx, r.out_tx) for r in linkage.pass_through(transfers(spark, *rows)).collect()]
    assert links(("A", "B", 1, 0, "1"), ("B", "C", 1, 600, "2")) == [("t0000", "t0001")]
    assert links(("A", "B", 1, 0, "1"), ("B", "C", 1, 601, "2")) == []
    assert links(("A", "B", 1, 5, "1"), ("B", "C", 1, 5, "2")) == [("t0000", "t0001")]
    # Only the nearest counts, though a later one would keep enough.
    assert links(("A", "B", 10, 0, "1"), ("B", "C", 1, 10, "2"), ("B", "D", 10, 20, "3")) == []
    assert links(("A", "B", 1, 0, "1"), ("B", "C", 50, 10, "2")) == [("t0000", "t0001")]
    assert links(("A", "B", 1, 20, "1"), ("B", "C", 1, 10, "2")) == []


def test_names_are_cut_by_default(spark):
    rows = [("Customer#01", "Zed1", 1, 0, "1"), ("Customer#02", "Zed2", 1, 86400, "2")]
    assert len(set(entity_map(spark, *rows).values())) == 3
    assert len(set(entity_map(spark, *rows, full_ids=True).values())) == 4


def test_co_input(spark):
    tx = transfers(spark, ("A", "Z", 1, 0, "1"), ("B", "Z", 1, 0, "2"), ("C", "Z", 1, 0, "3")).replace({"t0001": "t0000"}, subset=["tx_id"])
    assert {(r.a, r.b) for r in linkage.co_input_edges(tx).collect()} == {("B", "A")}
    assert linkage.co_input_merges(tx).first().merges == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components_like_union_find(spark, edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in touched}


def test_long_path(spark):
    path = spark.range(300).selectExpr("id as a", "id + 1 as b")
    got = connected_components(path).collect()
    assert len(got) == 301 and {r.component for r in got} == {0}


def labelled(spark, rows, entity):
    tx = transfers(spark, *rows)
    wallets = sorted({w for r in rows for w in r[:2]})
    return with_entities(tx, spark.createDataFrame([(w, entity(w)) for w in wallets], "wallet string, entity_id string"))


def test_features_by_hand(spark):
    rows = [("A", "B", 1, 0, "1"), ("A", "C", 3, 100, "2"), ("D", "A", 2, 400, "2")]
    f = {r.entity_id: r for r in entity_features(touches(labelled(spark, rows, lambda w: w))).collect()}
    a = f["A"]
    assert (a.tx_count, a.fan_in, a.fan_out, a.distinct_ip_count, a.distinct_asn_count) == (3, 1, 2, 2, 1)
    assert a.amount_mean == 2 and a.amount_std == pytest.approx(1) and a.amount_cv == pytest.approx(0.5)
    assert a.inter_tx_time_mean == 200 and a.inter_tx_time_std == pytest.approx(141.4213562)
    assert a.network_obfuscation_score == 0.5 and a.round_trip_time_mean == pytest.approx(400 / 3)
    assert f["B"].amount_std == f["B"].inter_tx_time_mean == 0


def test_transfers_within_an_entity_touch_it_twice(spark):
    f = entity_features(touches(labelled(spark, [("A", "B", 1, 0, "1")], lambda w: "E"))).first()
    assert (f.tx_count, f.fan_in, f.fan_out) == (1, 1, 1)


def flags(df):
    return {r[0]: r[1] for r in df.collect()}


def test_motifs(spark):
    hub = [(f"I{k}", "H", 1, k * 60, f"a{k}") for k in range(6)] + [("H", f"O{k}", 1, 900 + k * 60, f"b{k}") for k in range(6)]
    rows = labelled(spark, hub, lambda w: w)
    assert flags(motifs.peel_chain(rows))["H"] == 1.0
    assert flags(motifs.fan_pattern(rows))["H"] == 1.0
    assert flags(motifs.rapid_pass_through(rows))["H"] == 1.0
    got = {r.entity_id: (r.motif_score, r.motif_reasons) for r in motifs.motif_scores(rows).collect()}
    assert got["H"] == (1.0, "peel_chain, fan_pattern, rapid_pass_through")
    assert got["O1"] == (0.0, "none")


def test_fan_flags_when_the_last_transfer_is_internal(spark):
    chain = [(f"W{k}", f"W{k + 1}", 1, k * 60, f"{k}") for k in range(6)]
    rows = labelled(spark, chain, lambda w: "E")
    assert flags(motifs.fan_pattern(rows)) == {"E": 1.0}
    assert flags(motifs.peel_chain(rows)) == {"E": 0.0}


def test_whole_fixture_has_every_line_item(spark, tmp_path):
    rows = [(1, 1, 9, 1.0), (1, 2, 9, 30.0), (1, 3, 9, 2.0), (2, 4, 9, 7.0), (2, 4, 9, 1.0), (3, 5, 9, 1.0)]
    items = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double")
    items.selectExpr("*", "10.0D as l_extendedprice", "timestamp'2026-01-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    links = {(r.a, r.b) for r in catalog.co_input_links(spark, str(tmp_path)).collect()}
    assert links == {("P0000002", "P0000001"), ("P0000003", "P0000001")}
    assert {r.tx_id: r.merges for r in catalog.co_input_merge_counts(spark, str(tmp_path)).collect()} == {"ord1": 2, "ord2": 1}


def test_whole_truth_has_every_user(spark, tmp_path):
    spark.range(1, 48).selectExpr("id as user_id").write.parquet(f"{tmp_path}/events.parquet")
    truth = {r.entity_id: r.wallets.split(";") for r in fixtures.ground_truth(spark, str(tmp_path)).collect()}
    assert truth == {f"true_{g}": [f"W{u:07d}" for u in range(1, 48) if u // 20 == g] for g in range(3)}


def test_one_wallet_in_every_transfer(spark):
    """A wallet of 10^5 transfers, in and out by turns; linear in time and split over slices."""
    n = 100_000
    rows = spark.range(n).selectExpr("concat('t', lpad(id, 7, '0')) as tx_id", "timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, 0, id * 200) as timestamp", "if(id % 2 = 0, concat('A', id), 'HUB') as src_wallet", "if(id % 2 = 0, 'HUB', concat('B', id)) as dst_wallet", "1.0d as amount_btc", "'1' as broadcast_ip", "'AS1' as asn")
    links = linkage.pass_through(rows)
    assert links.count() == n // 2
    assert {r.gap_us for r in links.select("gap_us").distinct().collect()} == {200_000_000}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("AB"), st.sampled_from("ABC"), st.integers(0, 3000), st.integers(1, 4)), max_size=40), st.sampled_from([7, 600, 1000]))
def test_pass_through_like_brute_force(spark, moves, gap):
    rows = [(a, b, x, s, "1") for a, b, s, x in moves if a != b]
    got = sorted((r.in_tx, r.out_tx) for r in linkage.pass_through(transfers(spark, *rows) if rows else spark.createDataFrame([], SCHEMA), gap).collect())
    want = []
    for i, (_, b, x, s, _) in enumerate(rows):
        later = sorted((s2, j) for j, (a2, _, _, s2, _) in enumerate(rows) if a2 == b and s2 >= s)
        if later and later[0][0] - s <= gap and rows[later[0][1]][2] / x >= linkage.DEFAULTS.retention:
            want.append((f"t{i:04d}", f"t{later[0][1]:04d}"))
    assert got == sorted(want)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("AB"), st.integers(0, 20_000)), min_size=1, max_size=40), st.sampled_from([100.0, 3000.0]))
def test_gaps_and_medians_like_brute_force(spark, sends, limit):
    from statistics import median

    from ledgermill.functions.temporal import gaps

    rows = labelled(spark, [(w, "Z", 1, s, "1") for w, s in sends], lambda w: w)
    want = {}
    for w, s in sorted(sends):
        want.setdefault(w, []).append(s)
    want = {w: [b - a for a, b in zip(x, x[1:])] for w, x in want.items()}
    got = {}
    for r in gaps(rows, "src_entity").collect():
        got.setdefault(r.src_entity, []).append(r.gap_us / 1e6)
    assert {w: sorted(x) for w, x in got.items()} == {w: sorted(x) for w, x in want.items() if x}
    assert flags(motifs.rapid_pass_through(rows, limit)) == {w: float(median(x) <= limit) for w, x in want.items() if x}


def test_growing_input_like_one_run(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted(((f"W{rng.randrange(60):02d}", f"W{rng.randrange(60):02d}", rng.choice([1, 9, 10]), rng.randrange(40_000), str(rng.randrange(150))) for _ in range(160)), key=lambda r: r[3])
    rows = [r for r in rows if r[0] != r[1]]
    tx = transfers(spark, *rows)
    ids = spark.createDataFrame([(f"t{i:04d}", f"t{i // 2 * 2:04d}" if i % 30 < 2 else f"t{i:04d}") for i in range(len(rows))], "tx_id string, shared string")
    tx = tx.join(ids, "tx_id").drop("tx_id").withColumnRenamed("shared", "tx_id").select(*tx.columns)
    known, cuts = growing.nothing(tx), [0, 13_000, 13_100, 30_000, 50_000]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        known = growing.extend(known, tx.where((tx.timestamp >= T0 + timedelta(seconds=a)) & (tx.timestamp < T0 + timedelta(seconds=b))))
        known.save(f"{tmp_path}/{k}")
        known = growing.load(spark, f"{tmp_path}/{k}")
    want = {r.wallet: r.entity_id for r in linkage.wallet_entities(tx).collect()}
    assert 5 < len(set(want.values())) < 50
    assert {r.wallet: r.entity_id for r in known.entities().collect()} == want
    assert growing.extend(known, tx.limit(0)) is known
    with pytest.raises(ValueError, match="are known"):
        growing.extend(known, tx.limit(3))


def test_neighbourhoods_of_many_like_one_by_one(spark):
    rng = random.Random(5)
    nodes = [f"n{k}" for k in range(90)]
    e = spark.createDataFrame([("hub", rng.choice(nodes)) for _ in range(10)] + [(rng.choice(nodes), rng.choice(nodes)) for _ in range(70)], "src string, dst string")
    seeds = [(m, rng.choice([*nodes, "nowhere"])) for m in range(140) for _ in range(rng.choice([1, 1, 2]))]
    near = graph.neighbourhoods(e, spark.createDataFrame(seeds, "member long, id string"), 2)
    got = {(r.member, r.id, r.hop) for r in graph.members_of(near).collect()}
    edges = [(r.src, r.dst) for r in e.collect()]
    want = set()
    for m in {m for m, _ in seeds}:
        seen, front = {}, {i for n, i in seeds if n == m}
        for hop in range(3):
            seen |= {i: hop for i in front if i not in seen}
            front = {b for a, b in edges if a in front} | {a for a, b in edges if b in front}
        want |= {(m, i, hop) for i, hop in seen.items()}
    assert got == want
    reached = {m: {i for n, i, _ in want if n == m} for m in {m for m, _ in seeds}}
    inside = {(r.member, r.src, r.dst) for r in graph.members_of(graph.induced_edges_of(e.distinct(), near)).collect()}
    assert inside == {(m, a, b) for m, ids in reached.items() for a, b in edges if a in ids and b in ids}


def test_sliding_fan_like_brute_force_whatever_its_slices(spark, monkeypatch):
    draw = random.Random(3)
    epoch = datetime(1970, 1, 1)
    rows = [(draw.choice(["A", "A", "B", "C", None]), draw.choice(["A", "A", "A", "B", "C"]), epoch + timedelta(seconds=draw.choice([-1, 1]) * draw.randrange(4000), microseconds=draw.randrange(3))) for _ in range(90)]
    df = spark.createDataFrame(rows, "src_entity string, dst_entity string, timestamp timestamp_ntz")
    inside = lambda e, t, side: sum(r[side] == e and t <= r[2] <= t + timedelta(seconds=600) for r in rows)
    want = {e: float(any(e in r[:2] and inside(e, r[2], 1) >= 4 and inside(e, r[2], 0) >= 4 for r in rows)) for e in "ABC"}
    assert len(set(want.values())) == 2
    for width in (7, 300, 100_000):
        monkeypatch.setattr(motifs, "FAN_SLICE_S", width)
        assert {r.entity_id: r.sliding_fan_flag for r in motifs.sliding_fan(df, threshold=4, window_s=600).collect()} == want


def test_prefixes_of_many_networks_like_those_of_few(spark, monkeypatch):
    ips = fixtures.mixed_ips(spark, "/root/testdata/sf0.001").select(F.col("broadcast_ip").alias("ip")).distinct()
    found = lambda: sorted(map(str, enrich.lookup_prefixes(ips, fixtures.networks(spark)).collect()))
    few = found()
    monkeypatch.setattr(enrich, "FEW", 3)
    assert few and found() == few


def test_queries_find_entities_once(spark, monkeypatch):
    calls, real = [], linkage.wallet_entities
    monkeypatch.setattr(linkage, "wallet_entities", lambda tx: calls.append(1) or real(tx))
    for query in (catalog.confusion, catalog.alerts_filtered, catalog.community_isolation):
        calls.clear()
        query(spark, "/root/testdata/sf0.001")
        assert len(calls) == 1


def test_pass_through_orders_only_what_has_both_sides(spark):
    tx = transfers(spark, ("A", "B", 10, 0, "1"), ("B", "C", 9, 1300, "2"), ("C", "D", 9, 1850, "3"), *[(f"S{i}", f"X{i}", 1, 60 * i, "4") for i in range(50)])
    assert linkage._two_sided_cells(tx, 600).count() == 1  # C, whose transfers are 550 seconds apart; those of B are 1300
    assert [(r.wallet, r.gap_us) for r in linkage.pass_through(tx).collect()] == [("C", 550_000_000)]


def test_senders_are_compared_only_in_repeated_transactions(spark):
    tx = transfers(spark, ("A", "X", 1, 0, "1"), ("B", "X", 1, 0, "2"), ("C", "X", 1, 0, "3")).withColumn("tx_id", F.when(F.col("src_wallet") == "C", "t2").otherwise("t1"))
    assert sorted(r.src_wallet for r in linkage.repeated_transactions(tx).collect()) == ["A", "B"]
    assert {(r.a, r.b) for r in linkage.link_edges(tx).where("rule = 'co_input'").collect()} == {("B", "A")}


def test_evidence_of_few_and_of_many_rows(spark, monkeypatch):
    tx = transfers(spark, ("A", "B", 1, 0, "1"), ("B", "C", 1, 60, "2"), ("C", "D", 1, 120, "2"), ("E", "F", 1, 0, "3"))
    members = spark.createDataFrame([("e1", "A"), ("e2", "D"), ("e2", "F"), ("e3", "nobody")], "entity_id string, wallet string")
    found = lambda: [sorted(map(str, df.collect())) for df in explain.evidence_of(graph.vertices(tx), graph.edges(tx), members)]
    few = found()
    monkeypatch.setattr(session, "FEW_ROWS", 0)
    assert found() == few and few[0] and few[1]


def test_edges_are_not_shuffled_to_few_nodes(spark, capsys):
    e = graph.edges(transfers(spark, ("A", "B", 1, 0, "1"), ("B", "C", 1, 60, "2")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = graph.neighbourhoods(e, spark.createDataFrame([(0, "Wallet:A")], "member long, id string"), 2)
        graph.induced_edges_of(e, near).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rows_look_up_linked_wallets_only(spark, monkeypatch):
    tx = transfers(spark, ("A1", "X", 1, 0, "9"), ("A2", "Y", 1, 4000, "9"), ("longer than ten 1", "A2", 1, 9000, "8"), ("A1", None, 1, 9500, "9"))
    linked = linkage.linked_wallets(tx)
    assert {r.id for r in linked.collect()} == {"A1", "A2"}
    plain = with_entities(tx, linkage.wallet_entities(tx))
    assert sorted(map(str, with_linked(tx, linked).collect())) == sorted(map(str, plain.collect()))
    of = lambda few: (monkeypatch.setattr(catalog, "FEW_LINKED", few), sorted(map(str, catalog.labelled(spark, "/root/testdata/sf0.001").collect())))[1]
    assert of(0) == of(1_000_000)


def test_cells_with_both_sides_are_there_once(spark):
    tx = transfers(spark, *[("A", "B", 10, k, "1") for k in range(5)], *[("B", "C", 9, 100 + k, "2") for k in range(5)])
    cells = linkage._two_sided_cells(tx, 600)
    assert cells.count() == cells.distinct().count() == 1


def test_single_transactions_are_counted_and_repeated_ones_compared(spark):
    tx = transfers(spark, ("A", "B", 1, 0, "1"), ("A", "B", 1, 0, "2"), ("A", "C", 1, 0, "3"), ("B", "A", 1, 5, "4"), ("C", "D", 1, 5, "4"), ("A", "D", 1, 9, "5"))
    tx = tx.withColumn("tx_id", F.when(F.col("tx_id") != "t0005", F.when(F.col("broadcast_ip").isin("1", "2"), "same").otherwise(F.col("tx_id"))))  # the last has no id
    members = spark.createDataFrame([("A", "e1"), ("B", "e1"), ("C", "e2"), ("D", "e3")], "wallet string, entity_id string")
    rows = with_entities(tx, members)
    marked = touches(with_repeated(rows, linkage.repeated_hashes(tx)))
    assert marked.where("repeated").count() == 6 and marked.where("once").count() == 5
    one, other = entity_features(touches(rows)), entity_features(marked)
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert {r.entity_id: r.tx_count for r in other.collect()} == {"e1": 3, "e2": 2, "e3": 1}


def test_gaps_are_dealt_once(spark):
    rows = transfers(spark, ("A", "B", 1, 0, "1"), ("A", "C", 3, 100, "2"), ("D", "A", 2, 9000, "2"), ("A", "E", 2, 9000, "2"))
    found = gaps(rows, "src_wallet")
    assert sorted(r.gap_us for r in found.collect()) == [100_000_000, 8900_000_000]
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_ranking_needs_no_gaps(spark):
    f = catalog.features(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan(f)
    few = f.select("entity_id", *catalog.STAND_INS.values())
    assert "Window" not in plan(few)
    assert set(catalog._ranked_features(f).columns) == set(few.columns)
    got, want = catalog._aligned_stand_ins(f), fusion.aligned(catalog._stand_in_scores(f))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
