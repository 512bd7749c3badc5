"""Operators on small inputs with known answers, and against definitions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from edgewright.functions import sequence, vectors
from edgewright.operators import audit, graph, inference, metrics, negatives, splits, stats
from edgewright.sources import files, sinks
from edgewright.streaming import pairs as stream


def pairs_of(spark, rows):
    return spark.createDataFrame([(a, b, y, i) for i, (a, b, y) in enumerate(rows)], "a string, b string, label int, ord long")


def test_canonical_drops_self_pairs_conflicts_and_copies(spark):
    raw = pairs_of(spark, [("b", "a", 1), ("a", "b", 1), ("c", "c", 1), ("d", "e", 1), ("e", "d", 0), ("f", "a", 0)])
    once = audit.canonical(raw)
    assert {tuple(r)[:3] for r in once.collect()} == {("a", "b", 1), ("a", "f", 0)}
    assert {tuple(r) for r in audit.canonical(once).collect()} == {tuple(r) for r in once.collect()}
    counts = audit.issue_counts(raw).first()
    assert (counts["self_pairs"], counts["conflict_pairs"], counts["reversed_duplicates"], counts["duplicates_removed"], counts["canonical_pairs"]) == (1, 1, 2, 1, 2)


def test_label_outside_domain_fails(spark):
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        audit.checked_labels(pairs_of(spark, [("a", "b", 2)])).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}


def test_two_components_of_pairs(spark):
    pairs = pairs_of(spark, [("P1", "Q1", 1), ("P1", "Q2", 0), ("P2", "Q1", 1), ("P3", "Q3", 0), ("P3", "Q4", 1), ("P4", "Q3", 0)])
    labels = graph.components(pairs)
    assert labels.select("component").distinct().count() == 2


def test_auc_equals_pair_counting(spark):
    rng = random.Random(3)
    rows = [("g", rng.randrange(2), rng.randrange(6) / 5) for _ in range(80)]
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    expected = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(spark.createDataFrame(rows, "grp string, y int, p double")).first()["roc_auc"] == pytest.approx(expected, abs=1e-6)


def test_perfect_and_single_class_scores(spark):
    rows = [("perfect", y, p) for y, p in ((0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9))] + [("single", 1, 0.6), ("single", 1, 0.4)]
    scored = spark.createDataFrame(rows, "grp string, y int, p double")
    assert {r["grp"]: r["roc_auc"] for r in metrics.roc_auc(scored).collect()} == {"perfect": 1.0, "single": None}
    assert {r["grp"]: (r["mcc"], r["accuracy"]) for r in metrics.confusion(scored).collect()}["perfect"] == (1.0, 1.0)


def test_constant_scores_have_no_equal_frequency_error(spark):
    assert metrics.ece_frequency(spark.createDataFrame([("g", i % 2, 0.7) for i in range(10)], "grp string, y int, p double")).first()["ece"] == 0


def test_adjusted_p_values(spark):
    rows = [("f", i, p) for i, p in enumerate((0.001, 0.01, 0.02, 0.5))] + [("g", 0, 0.01), ("g", 1, None), ("g", 2, 0.2)]
    found = {(r["family"], r["test"]): (r["p_adj"], r["reject"]) for r in inference.adjusted(spark.createDataFrame(rows, "family string, test int, p double")).collect()}
    assert [found["f", i][0] for i in range(4)] == pytest.approx([0.004, 0.02, 0.0266667, 0.5], abs=1e-6)
    assert [found["f", i][1] for i in range(4)] == [True, True, True, False]
    assert (found["g", 0][0], found["g", 1], found["g", 2][0]) == (pytest.approx(0.02), (None, False), pytest.approx(0.2))


def test_t_distribution():
    assert inference.t_quantile(0.975, 18) == pytest.approx(2.10092, abs=1e-4)
    assert inference.t_quantile(0.975, 4) == pytest.approx(2.77645, abs=1e-4)
    assert inference.t_two_sided(2.10092, 18) == pytest.approx(0.05, abs=1e-5)
    assert inference.t_two_sided(0.0, 5) == 1.0


def test_bootstrap_draws_whole_components(spark):
    drawn = inference.multiplicities(spark.createDataFrame([(i,) for i in range(7)], "component int"), 20)
    assert {r["n"] for r in drawn.groupBy("replicate").agg(F.sum("times").alias("n")).collect()} == {7}


def test_one_component_has_no_interval(spark):
    scored = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.1)], "component int, y int, p double")
    row = inference.jackknife(scored).withColumn("t", inference.t_interval("full_auc", "variance", "components")).select("t.*").first()
    assert tuple(row) == (None, None, None)


def test_holdout_keeps_every_entity_in_training(spark):
    rng = random.Random(5)
    edges = list({(f"n{rng.randrange(30):02}", f"n{30 + rng.randrange(30):02}", 1) for _ in range(200)})
    split = splits.degree_safe_holdout(pairs_of(spark, edges).drop("ord"))
    sides = {s: [(r["a"], r["b"]) for r in split.filter(F.col("side") == s).collect()] for s in ("train", "test")}
    assert {x for e in sides["test"] for x in e} <= {x for e in sides["train"] for x in e}
    assert len(sides["train"]) + len(sides["test"]) == len(edges) and 0.05 < len(sides["test"]) / len(edges) < 0.35


def test_gate_notices_injected_leak(spark):
    rows = [("R3", "train", "a", "b", 1), ("R3", "test", "c", "d", 1)]
    clean = spark.createDataFrame(rows, "regime string, side string, a string, b string, label int")
    leaky = clean.union(spark.createDataFrame([("R3", "test", "b", "a", 1)], clean.schema))
    assert splits.gates(splits.leakage(clean)).first()["passed"] and not splits.gates(splits.leakage(leaky)).first()["passed"]


@pytest.mark.parametrize("both", [False, True])
def test_negatives_keep_the_contract(spark, both):
    positives = spark.createDataFrame([(i, i + 20) for i in range(20)] + [(i, 39 - i) for i in range(19)], "a long, b long").distinct()
    entities = spark.createDataFrame([(i, i % 3, "x") for i in range(40)], "entity long, stratum long, cluster string")
    made = negatives.matched(positives, entities, "set", both=both)
    found = negatives.checks(made, positives, entities).agg(F.sum("n").alias("n"), F.sum("broken").alias("broken")).first()
    assert tuple(found) == (positives.count(), 0)
    for r in made.collect():
        strata = lambda *x: sorted(i % 3 for i in x)
        assert strata(r["a"], r["b"]) == strata(r["of_a"], r["of_b"])
        assert both or {r["a"], r["b"]} & {r["of_a"], r["of_b"]}


def test_a_hub_finds_the_one_entity_left(spark):
    """Linked to all of its stratum but one: draws miss it, going through the stratum doesn't."""
    positives = spark.createDataFrame([(0, i) for i in range(2, 600)], "a long, b long")
    entities = spark.createDataFrame([(i, 0) for i in range(600)], "entity long, stratum long")
    made = {(r["a"], r["b"]) for r in negatives.matched(positives, entities, "set", draws=1, rounds=1).collect()}
    assert (0, 1) in made and not made & {(0, i) for i in range(2, 600)}
    kept_a = positives.filter(negatives.below(F.lit(2), negatives.SEED, F.lit("side"), "a", "b") == 0).count()
    assert len(made) == positives.count() - kept_a + 1


def test_nearest_degree_is_taken_first(spark):
    positives = spark.createDataFrame([(0, 1), (2, 3), (4, 5)], "a long, b long")
    entities = spark.createDataFrame([(i, 10 * (i % 6)) for i in range(36)], "entity long, stratum long")
    of = {r["entity"]: r["stratum"] for r in entities.collect()}
    for r in negatives.nearest(positives, entities, "set").collect():
        assert sorted(of[x] for x in (r["a"], r["b"])) == sorted(of[x] for x in (r["of_a"], r["of_b"]))
    lonely = spark.createDataFrame([(i, d) for i, d in enumerate((0, 5, 7, 50, 51))], "entity long, stratum long")
    one = spark.createDataFrame([(0, 1)], "a long, b long")
    row = negatives.nearest(one, lonely, "set").first()
    assert {row["a"], row["b"]} in ({0, 2}, {1, 2}) and negatives.nearest(one, lonely, "set", caliper=1).count() == 0
    assert negatives.nearest(one, lonely, "set", candidates=lonely.filter("entity > 2")).select("a", "b").first()[1] == 3


def test_running_values_in_slices(spark, monkeypatch):
    from edgewright.operators import ranges

    rng = random.Random(8)
    rows = [(g, x, rng.randrange(9)) for g in ("p", "q") for x in rng.sample(range(1000), 150)]
    df = spark.createDataFrame(rows, "g string, x long, v long")
    for descending in (False, True):
        ask = lambda: sorted(map(tuple, ranges.running(df, ["g"], "x", {"up": F.col("v")}, {"low": F.col("v")}, descending).select("g", "x", "up", "low", "all_up").collect()))  # noqa: B023, E731
        monkeypatch.setattr(ranges, "SLICE", 1 << 20)
        whole = ask()
        monkeypatch.setattr(ranges, "SLICE", 20)
        assert ask() == whole and len(whole) == 300
    quantile = {r["g"]: r["q"] for r in ranges.quantiles(df, ["g"], "x", [0.0, 0.3, 1.0], "q").collect()}
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.0), F.lit(0.3), F.lit(1.0))).alias("q")).collect()}
    assert all(quantile[g] == pytest.approx(want[g]) for g in want)


def test_components_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "IN_ONE_TASK", 0)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 250), (250, 220)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == dict.fromkeys(range(41), 0) | {100: 100} | dict.fromkeys((200, 220, 250), 200)


def test_equal_clusters_exclude_all(spark):
    positives = spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")
    entities = spark.createDataFrame([(i, 0, None) for i in range(8)], "entity long, stratum long, cluster string")
    assert negatives.matched(positives, entities, "set", exclude_cluster=True, rounds=2).count() == 0


def test_description_and_deciles(spark):
    d = stats.describe(spark.createDataFrame([("s", x) for x in (1, 2, 3, 4, 100)], "set_name string, x long")).first()
    assert (d["n"], d["mean"], d["q1"], d["median"], d["q3"]) == (5, 22, 2, 3, 4)
    n = 57
    ranked = stats.ranked(spark.createDataFrame([(i, i % 4) for i in range(n)], "id long, v long"), "v", "id").withColumn("decile", stats.rank_decile())
    rows = sorted(ranked.collect(), key=lambda r: r["rank"])
    assert [r["id"] for r in rows] == sorted(range(n), key=lambda i: (i % 4, i))
    assert [r["decile"] for r in rows] == [max(0, math.ceil((r - 1) * 10 / (n - 1)) - 1) for r in range(1, n + 1)]


def test_fusions(spark):
    pairs = spark.createDataFrame([("A", "B"), ("B", "A")], "a string, b string")
    v = spark.createDataFrame([("A", [1.0, 3.0]), ("B", [2.0, 4.0])], "entity string, v array<double>")
    assert [list(r["feat"]) for r in vectors.fuse(pairs, v).collect()] == [[3, 7, 1, 1, 2, 12]] * 2
    assert len({tuple(r["feat"]) for r in vectors.fuse(pairs, v, "joined").collect()}) == 2


def test_sequence_features(spark):
    df = spark.createDataFrame([(1, "MKTAYIAKQR"), (2, ""), (3, None), (4, "xx")], "entity_id long, seq string")
    shares = sequence.composition(df).groupBy("entity_id").agg(F.sum("value").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1, abs=1e-4) for r in shares)
    for f, n in ((sequence.ctd_composition, 21), (sequence.ctd_transition, 21), (sequence.ctd_distribution, 105)):
        rows = f(df).collect()
        assert len(rows) == 4 * n and all(0 <= r["value"] <= 1 for r in rows)


def test_feature_vectors(spark):
    df = spark.createDataFrame([(1, "MKTAYIAKQR"), (2, "A")], "entity_id long, seq string")
    v = {r["entity"]: r["v"] for r in sequence.feature_vectors(df).collect()}
    assert len(sequence.feature_names()) == 167 and all(len(x) == 167 and None not in x for x in v.values())
    assert v[1][:3] == [0.2, 0.0, 0.0] and v[2][0] == 1.0


def test_command_line(spark, tmp_path):
    from edgewright.__main__ import main

    (tmp_path / "e.tsv").write_text("P1\tMKT\nP2\tACD\nP3\tACD\n")
    (tmp_path / "p.tsv").write_text("P1\tP2\t1\nP2\tP1\t1\nP3\tP1\t0\n")
    main(["validate", "--entities", str(tmp_path / "e.tsv"), "--pairs", str(tmp_path / "p.tsv"), "--out", str(tmp_path / "o")], spark)
    audit_row = spark.read.json(str(tmp_path / "o" / "audit")).first()
    assert (audit_row["canonical_pairs"], audit_row["reversed_duplicates"], audit_row["n_shared"]) == (2, 1, 1)
    assert spark.read.parquet(str(tmp_path / "o" / "canonical_pairs")).count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "e.fasta").write_text(">P1 first\nMKT\nAYI\n>P2\nacd\n\n")
    assert {tuple(r) for r in files.read_entities(spark, str(tmp_path / "e.fasta")).collect()} == {("P1", "MKTAYI"), ("P2", "ACD")}
    (tmp_path / "p.tsv").write_text("protein_a\tprotein_b\tlabel\nNA\tx\t1\nnan\ty\t0\n")
    assert {tuple(r) for r in files.read_pairs(spark, str(tmp_path / "p.tsv")).collect()} == {("NA", "x", 1), ("nan", "y", 0)}
    (tmp_path / "q.csv").write_text("u,v\nw,x\n")
    assert {tuple(r) for r in files.read_pairs(spark, str(tmp_path / "q.csv")).collect()} == {("u", "v", 1), ("w", "x", 1)}
    (tmp_path / "c.tsv").write_text("rep\tmember\n")
    assert [tuple(r) for r in files.read_clusters(spark, str(tmp_path / "c.tsv")).collect()] == [("member", "rep")]
    (tmp_path / "d.tsv").write_text("cluster_id\tprotein_id\nrep\tmember\nrep\trep\n")
    assert {tuple(r) for r in files.read_clusters(spark, str(tmp_path / "d.tsv")).collect()} == {("member", "rep"), ("rep", "rep")}
    (tmp_path / "e.tsv").write_text("a\tb\t1\nc\td\t0\n")
    assert {tuple(r) for r in files.read_pairs(spark, str(tmp_path / "e.tsv")).collect()} == {("a", "b", 1), ("c", "d", 0)}
    (tmp_path / "f.txt").write_text("id=7 x id=9\nnone\n")
    assert [r["n"] for r in files.read_matches(spark, str(tmp_path / "f.txt"), {"n": r"id=(\d+)"}).collect()] == ["7 9", None]
    (tmp_path / "g.json").write_text('{"auc": 0.5, "other": {"x": 1}}')
    assert [tuple(r) for r in files.read_results(spark, str(tmp_path / "g.json"), "auc double, other struct<x: int>").selectExpr("auc", "other.x").collect()] == [(0.5, 1)]
    assert [tuple(r) for r in files.read_named(spark, str(tmp_path / "e.tsv"), ["x", "y"]).collect()] == [("a", "b"), ("c", "d")]
    pieces = sequence.chunks(spark.createDataFrame([("p", "ABCDEFG"), ("q", "")], "entity_id string, seq string"), 4, 1).collect()
    assert sorted((r["entity_id"], r["chunk"], r["weight"], r["seq"]) for r in pieces) == [("p", 0, 4, "ABCD"), ("p", 1, 4, "DEFG"), ("q", 0, 0, "")]
    import numpy as np

    np.savez(tmp_path / "v.npz", ids=np.array(["a", "b"]), X=np.arange(4.0).reshape(2, 2))
    assert {(r["entity"], tuple(r["v"])) for r in files.read_embeddings(spark, str(tmp_path / "v.npz")).collect()} == {("a", (0.0, 1.0)), ("b", (2.0, 3.0))}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("R0", "test", "a", "b", 1)], "regime string, side string, a string, b string, label int")
    sinks.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    assert sinks.markdown_rows(spark.createDataFrame([("x", 0.12345, 12345)], "a string, b double, c long")).first()["line"] == "| x | 0.123 | 12,345 |"
    assert "pyspark" in sinks.manifest(seed=42)


def test_demo_runs_to_its_report(spark, tmp_path, monkeypatch):
    """Regimes and a control set are scored, with intervals, and the gates pass."""
    from edgewright.__main__ import main
    from edgewright.plans import framework

    monkeypatch.setattr(framework, "CONTROLS", {"N2": ("degree_decile",)})
    out = str(tmp_path / "demo")
    main(["demo", "--out", out, "--size", "120", "--replicates", "20"], spark)
    scores = {r["regime"]: r for r in spark.read.json(f"{out}/scores").collect()}
    assert {"R0", "R1", "N2", "N2_nearest"} <= set(scores) and all(0 <= r["roc_auc"] <= 1 for r in scores.values() if r["roc_auc"] is not None)
    assert {r["regime"] for r in spark.read.json(f"{out}/uncertainty").collect()} == set(scores)
    assert spark.read.json(f"{out}/audit").first()["conflict_pairs"] > 0
    report = [r["value"] for r in spark.read.text(f"{out}/report").collect()]
    assert [x for x in report if x.startswith("##")] == ["## scores", "## uncertainty", "## balance"]


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = tmp_path / "events"
    events.write.parquet(str(source))
    live = stream.windowed_counts(spark.readStream.schema(events.schema).parquet(str(source)))
    q = live.writeStream.outputMode("complete").format("memory").queryName("live_counts").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("live_counts").collect()} == {tuple(r) for r in stream.windowed_counts(events).collect()}


def test_isoelectric_points_of_known_chains(spark):
    """The first and last letters have pK of their own; a chain without charged letters lies between its ends."""
    chains = {"INGAR": 9.75, "ACKFV": None, "GGGGG": (7.5 + 3.55) / 2, "MGGGG": (7.0 + 3.55) / 2, "VAAAA": (7.44 + 3.55) / 2}
    rows = spark.createDataFrame(list(chains.items()), "seq string, want double").select(F.col("seq").alias("entity_id"), "seq")
    found = {r["entity_id"]: r["isoelectric_point"] for r in sequence.isoelectric_points(rows).collect()}
    assert all(found[s] == pytest.approx(want, abs=0.01) for s, want in chains.items() if want)


def test_pair_index(spark):
    rows = spark.createDataFrame([(1, "ACAC"), (2, "A"), (3, None), (4, "xACx")], "entity_id int, seq string")
    weights = spark.createDataFrame([("AC", 2.0), ("CA", -1.0), ("A?", 9.0)], "pair string, weight double")
    found = {r["entity_id"]: r["pair_index"] for r in sequence.pair_index(rows, weights).collect()}
    assert found == {1: 7.5, 2: 0.0, 3: 0.0, 4: 10.0}
    assert {r["pair_index"] for r in sequence.pair_index(rows.filter("entity_id = 4"), weights.limit(0), 1.0).collect()} == {5.0}


def test_welch_p_value(spark):
    """Against the area of Student's density beyond the ratio, by a fine sum."""
    rows = spark.createDataFrame([(0.1, 0.05, 7.5), (-0.3, 0.1, 3.0), (0.0, 0.2, 9.0)], "difference double, se double, df double")
    for r in rows.withColumn("p", inference.t_p_value("difference", "se", "df")).collect():
        t, df = abs(r["difference"] / r["se"]), r["df"]
        density = lambda x: math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)  # noqa: B023, E731
        inner = sum(density((i + 0.5) * t / 4000) for i in range(4000)) * t / 4000
        assert r["p"] == pytest.approx(1 - 2 * inner, abs=1e-6)
