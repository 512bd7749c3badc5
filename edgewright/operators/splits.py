"""Train/test regimes of rising novelty, and the gates against leakage.

All regimes are one long table (regime, side, a, b, label). Random choices compare a repeatable
uniform draw with the wanted share, so no row is ranked against all others and sides are made in
one pass; a share is met as closely as a draw meets it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.functions.draws import ticket, uniform
from edgewright.operators import selection
from edgewright.operators.ranges import checkpointed

SEED, TEST_SHARE = 42, 0.2


def _side(test: Column) -> Column:
    return F.when(test, "test").otherwise("train").alias("side")


def random_split(pairs: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """R0: each pair drawn for itself, within its label."""
    return pairs.select(F.lit("R0").alias("regime"), _side(uniform(seed, "label", "a", "b") < share), "a", "b", "label")


def stratified_split(pairs: DataFrame, share: float = TEST_SHARE, seed: int = SEED, ends: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """R0 with exact counts: of each label, the share, rounded, of least tickets is tested."""
    chosen = selection.first(pairs.withColumn("ticket", ticket(seed, "label", *ends)), ["label"], "ticket", [*ends], share)
    return chosen.select(F.lit("R0").alias("regime"), _side(F.col("chosen")), "a", "b", "label")


def counted_pools(groups: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Like ``pools``, with exactly the share, rounded, of the groups in the test pool."""
    drawn = groups.select("grp").distinct().withColumn("ticket", ticket(seed, "grp"))
    chosen = selection.first(drawn, [], "ticket", ["grp"], share)
    return groups.join(chosen.select("grp", F.when(F.col("chosen"), "test").otherwise("train").alias("pool")), "grp").select(*groups.columns, "pool")


def folds(pairs: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    """Stratified folds: dealt in turn by ticket within (label, first two digits of the ticket)."""
    drawn = pairs.withColumn("ticket", ticket(seed, "a", "b")).withColumn("range", F.substring("ticket", 1, 2))
    turn = F.row_number().over(Window.partitionBy("label", "range").orderBy("ticket", "a", "b"))
    return drawn.select("a", "b", "label", (turn % k).alias("fold"))


def pools(groups: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """(entity, grp) to (entity, grp, pool): whole groups go to the train or the test pool."""
    return groups.withColumn("pool", F.when(uniform(seed, "grp") < share, "test").otherwise("train"))


def membership(pairs: DataFrame, pooled: DataFrame) -> DataFrame:
    """Pairs with both_train, both_test, mixed, or unassigned where an end has no pool."""
    left, right = (pooled.select(F.col("entity").alias(x), F.col("pool").alias(f"pool_{x}"), F.col("grp").alias(f"grp_{x}")) for x in ("a", "b"))
    joined = pairs.join(left, "a", "left").join(right, "b", "left")
    x, y = F.col("pool_a"), F.col("pool_b")
    kind = F.when(x.isNull() | y.isNull(), "unassigned").when((x == "train") & (y == "train"), "both_train").when((x == "test") & (y == "test"), "both_test").otherwise("mixed")
    return joined.withColumn("membership", kind)


def degree_safe_holdout(pairs: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Pairs with a side: a pair may be tested only if both ends keep another pair in training.

    Every entity protects the pair of its greatest ticket, one aggregate over ends; pairs that no
    end protects are drawn at a rate that makes up for the protected ones, as far as it can."""
    drawn = pairs.withColumn("ticket", ticket(seed, "a", "b"))
    ends = drawn.select(F.col("a").alias("node"), "a", "b", "ticket").union(drawn.select(F.col("b").alias("node"), "a", "b", "ticket"))
    guarded = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("ticket", "a", "b")).alias("p")).select("p.a", "p.b").distinct().withColumn("guarded", F.lit(True))
    marked = drawn.join(guarded, ["a", "b"], "left").withColumn("guarded", F.coalesce("guarded", F.lit(False)))
    rate = marked.agg((share * F.count("*") / F.greatest(F.count_if(~F.col("guarded")), F.lit(1))).alias("rate"))
    drawn_out = ~F.col("guarded") & (uniform(seed + 1, "a", "b") < F.col("rate"))
    return marked.join(F.broadcast(rate)).select(F.lit("R1").alias("regime"), _side(drawn_out), "a", "b", "label")  # one row of rate


def greedy_holdout(pairs: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Pairs with a side: by ticket, a pair is tested if both its ends keep another pair in training,
    until the share, rounded, of all is reached; the same pairs as a walk in the order of tickets takes.

    A walk can only refuse a pair at an end of which it is the last one, and does if all others of that
    end were taken. So only last pairs, one an entity at most, are in doubt, and each waits for the
    last pairs of other entities among those of its end: it is taken once one of them at each end was
    refused, and refused once all of them at one end were taken. Rounds settle all that can be."""
    drawn = checkpointed(pairs.withColumn("ticket", ticket(seed, "a", "b")))
    key = F.struct("ticket", "a", "b")
    ends = drawn.select(F.col("a").alias("node"), "a", "b", "ticket").union(drawn.select(F.col("b").alias("node"), "a", "b", "ticket"))
    last = checkpointed(ends.groupBy("node").agg(F.max(key).alias("last")))
    doubtful = last.select("last").distinct()
    #: (last, node, other): the doubtful pair ``other`` is one of the node's, whose last is ``last``.
    waits = ends.select("node", key.alias("other")).join(doubtful.withColumnRenamed("last", "other"), "other").join(last, "node").filter("other <> last").select("node", "last", "other")
    waits, open_, refused = checkpointed(waits), checkpointed(last), None
    while not open_.isEmpty():  # (node, last) that neither took nor refused its last pair
        held = waits.groupBy("node").agg(F.count("*").alias("n"))
        state = open_.join(held, "node", "left")
        bad = state.filter("n IS NULL").select("last").distinct()  # all others of the node were taken
        settled = bad.withColumn("refused", F.lit(True))
        freed = waits.join(bad.withColumnRenamed("last", "other"), "other").select("node", "last").distinct()  # one other stays in training
        clear = open_.join(freed, ["node", "last"], "left_anti")
        taken = open_.select("last").distinct().join(clear.select("last").distinct(), "last", "left_anti").join(bad, "last", "left_anti")
        settled = checkpointed(settled.union(taken.withColumn("refused", F.lit(False))))
        refused = bad if refused is None else refused.union(bad)
        refused = checkpointed(refused.distinct())
        open_ = checkpointed(clear.join(settled, "last", "left_anti"))
        waits = checkpointed(waits.join(freed, ["node", "last"], "left_anti").join(settled.withColumnRenamed("last", "other"), "other", "left_anti").select("node", "last", "other"))
    marked = drawn.withColumn("at", key)
    marked = marked.join(refused.select(F.col("last").alias("at"), F.lit(True).alias("refused")), "at", "left") if refused is not None else marked.withColumn("refused", F.lit(None).cast("boolean"))
    marked = checkpointed(marked.select("a", "b", "label", "ticket", F.coalesce("refused", F.lit(False)).alias("refused")))
    target = marked.agg(selection.rounded(F.count("*"), share)).first()[0]
    chosen = selection.first(marked.filter("NOT refused"), [], "ticket", ["a", "b"], count=target)
    both = chosen.select("a", "b", "label", "chosen").union(marked.filter("refused").select("a", "b", "label", F.lit(False)))
    return both.select(F.lit("R1").alias("regime"), _side(F.col("chosen")), "a", "b", "label")


def novelty(pairs: DataFrame, pooled: DataFrame, share: float = TEST_SHARE, seed: int = SEED, holdout_by=degree_safe_holdout) -> DataFrame:
    """R1 both ends seen, R2 exactly one seen, R3 none seen; all train on the same pairs.

    R2 drops pairs whose train-pool end has no pair in training."""
    placed = checkpointed(membership(pairs, pooled))  # read three times
    r1 = holdout_by(placed.filter("membership = 'both_train'").select(*pairs.columns), share, seed)
    r1 = checkpointed(r1)
    train = r1.filter("side = 'train'")
    seen = train.select(F.col("a").alias("known")).union(train.select("b")).distinct()
    mixed = placed.filter("membership = 'mixed'").withColumn("known", F.when(F.col("pool_a") == "train", F.col("a")).otherwise(F.col("b")))
    r2 = mixed.join(seen, "known", "left_semi").select(F.lit("R2").alias("regime"), F.lit("test").alias("side"), "a", "b", "label")
    r3 = placed.filter("membership = 'both_test'").select(F.lit("R3").alias("regime"), F.lit("test").alias("side"), "a", "b", "label")
    shared = [train.withColumn("regime", F.lit(name)) for name in ("R2", "R3")]
    return r1.union(r2).union(r3).union(shared[0]).union(shared[1])


def cluster_disjoint(pairs: DataFrame, clusters: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """R3-C: pairs within the train or the test pool of clusters; an entity without one is its own."""
    ends = pairs.select(F.col("a").alias("entity")).union(pairs.select("b")).distinct()
    grouped = ends.join(clusters, "entity", "left").withColumn("grp", F.coalesce("grp", F.concat(F.lit("own|"), F.col("entity").cast("string"))))
    placed = membership(pairs, pools(grouped, share, seed)).filter("membership in ('both_train', 'both_test')")
    return placed.select(F.lit("R3-C").alias("regime"), _side(F.col("membership") == "both_test"), "a", "b", "label")


def label_balance(splits: DataFrame) -> DataFrame:
    return splits.groupBy("regime", "side", "label").agg(F.count("*").alias("n"))


def leakage(splits: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row a regime: pairs and entities on both sides, and test pairs by how many ends are seen.

    Each count is one aggregate by regime and key, so all regimes share a plan."""
    splits = checkpointed(splits)  # read by every count
    canonical = splits.select("regime", "side", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    both = lambda keyed, name: keyed.groupBy("regime", "key").agg(F.count_if(F.col("side") == "train").alias("x"), F.count_if(F.col("side") == "test").alias("y")).groupBy("regime").agg(F.count_if((F.col("x") > 0) & (F.col("y") > 0)).alias(name))
    ends = canonical.select("regime", "side", F.col("a").alias("key")).union(canonical.select("regime", "side", "b"))
    out = both(canonical.select("regime", "side", F.struct("a", "b").alias("key")), "shared_pairs").join(both(ends, "shared_entities"), "regime")
    if groups is not None:
        grouped = ends.withColumnRenamed("key", "entity").join(groups, "entity").select("regime", "side", F.col("grp").alias("key"))
        out = out.join(both(grouped, "shared_groups"), "regime", "left")
    seen = ends.filter("side = 'train'").select("regime", "key").distinct().withColumn("seen", F.lit(1))
    test = canonical.filter("side = 'test'")
    for x in ("a", "b"):
        test = test.join(seen.select("regime", F.col("key").alias(x), F.col("seen").alias(f"seen_{x}")), ["regime", x], "left")
    n = F.coalesce("seen_a", F.lit(0)) + F.coalesce("seen_b", F.lit(0))
    return out.join(test.groupBy("regime").agg(*(F.count_if(n == i).alias(f"tests_{i}_seen") for i in range(3))), "regime", "left").na.fill(0)


def gates(report: DataFrame) -> DataFrame:
    """The report with ``passed``: no shared pair, and as many ends seen as the regime says."""
    r = F.col("regime")
    fine = (F.col("shared_pairs") == 0) & F.when(r == "R1", F.col("tests_0_seen") + F.col("tests_1_seen") == 0).when(r == "R2", F.col("tests_0_seen") + F.col("tests_2_seen") == 0).when(r.startswith("R3"), F.col("shared_entities") == 0).otherwise(True)
    return report.withColumn("passed", fine)


def holdout(rows: DataFrame, keys: list[str], share: float = 0.15, seed: int = SEED) -> DataFrame:
    """``rows`` with ``held``: a share of each label kept back, for early stopping."""
    return rows.withColumn("held", uniform(seed, "label", *keys) < share)


def overlap(split: DataFrame) -> DataFrame:
    """One row about a supplied split (side, a, b, ...): test pairs that training has as they are, turned
    round, or either way, and entities of test pairs that training names."""
    pairs = checkpointed(split.groupBy("a", "b").agg(F.count_if(F.col("side") == "train").alias("x"), F.count_if(F.col("side") == "test").alias("y")))
    turned = pairs.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("x").alias("turned"))
    test = pairs.filter("y > 0").join(turned, ["a", "b"], "left").na.fill(0, ["turned"])
    found = test.agg(F.count("*").alias("test_pairs"), F.count_if(F.col("x") > 0).alias("same"), F.count_if((F.col("turned") > 0) & (F.col("a") != F.col("b"))).alias("reversed"), F.count_if((F.col("x") > 0) | (F.col("turned") > 0)).alias("either"))
    ends = split.select("side", F.explode(F.array("a", "b")).alias("entity")).groupBy("entity").agg(F.count_if(F.col("side") == "train").alias("x"), F.count_if(F.col("side") == "test").alias("y"))
    return found.join(ends.agg(F.count_if(F.col("y") > 0).alias("test_entities"), F.count_if((F.col("x") > 0) & (F.col("y") > 0)).alias("shared_entities")))  # one row each


def integrity(split: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per threshold of ``clusters`` (threshold, entity, grp): clusters on both sides of a split, and the
    share of test entities in them."""
    ends = split.select("side", F.explode(F.array("a", "b")).alias("entity")).distinct().join(clusters, "entity")
    groups = ends.groupBy("threshold", "grp").agg(F.count_if(F.col("side") == "train").alias("x"), F.count_if(F.col("side") == "test").alias("y"))
    both = (F.col("x") > 0) & (F.col("y") > 0)
    return groups.groupBy("threshold").agg(F.count("*").alias("groups"), F.count_if(both).alias("shared_groups"), F.sum("y").alias("test_entities"), F.round(F.try_divide(F.sum(F.when(both, F.col("y"))), F.sum("y")), 6).alias("leaking_share"))


def integrity_audit(split: DataFrame, clusters: DataFrame, entities: DataFrame) -> DataFrame:
    """One row a ``name`` of ``split`` (name, side, a, b): pairs and entities of both sides, how many entities,
    sequences, clusters (name, entity, grp) and pairs, either way round, both sides have, and whether none is.

    ``entities`` has (entity, seq); each count is one aggregate by name and key."""
    split = checkpointed(split.select("name", "side", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    ends = checkpointed(split.select("name", "side", F.explode(F.array("a", "b")).alias("entity")).distinct())
    train, test = F.count_if(F.col("side") == "train"), F.count_if(F.col("side") == "test")
    out = split.groupBy("name").agg(train.alias("train_pairs"), test.alias("test_pairs")).join(ends.groupBy("name").agg(train.alias("train_entities"), test.alias("test_entities")), "name", "left")
    digests = entities.filter("seq IS NOT NULL").select("entity", F.sha2("seq", 256).alias("key"))
    shared = {
        "shared_entities": ends.withColumnRenamed("entity", "key"), "shared_sequences": ends.join(digests, "entity"),
        "shared_clusters": ends.join(clusters.withColumnRenamed("grp", "key"), ["name", "entity"]), "shared_pairs": split.select("name", "side", F.struct("a", "b").alias("key")),
    }
    for column, keyed in shared.items():
        sides = keyed.groupBy("name", "key").agg(train.alias("x"), test.alias("y"))
        out = out.join(sides.groupBy("name").agg(F.count_if((F.col("x") > 0) & (F.col("y") > 0)).alias(column)), "name", "left")
    return out.na.fill(0).withColumn("passed", sum((F.col(c) for c in shared), F.lit(0)) == 0)


def grouped_share(groups: DataFrame) -> DataFrame:
    """One row: members of groups (entity, grp), and the share of them that aren't alone in theirs."""
    size = groups.groupBy("grp").agg(F.count("*").alias("size"))
    return size.agg(F.sum("size").alias("members"), F.count("*").alias("groups"), F.round(F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0)) / F.sum("size"), 6).alias("share_not_alone"))


def train_degrees(split: DataFrame) -> DataFrame:
    """(entity, degree, train_degree): positive pairs of each entity in all and in training alone."""
    ends = split.filter("label = 1").select("side", F.explode(F.array("a", "b")).alias("entity"))
    return ends.groupBy("entity").agg(F.count("*").alias("degree"), F.count_if(F.col("side") == "train").alias("train_degree"))


def weighted_choice(rows: DataFrame, key: str, weight: str, k: int, seed: int = SEED) -> DataFrame:
    """``k`` rows without replacement, each time with a chance in proportion to what is left: those of
    the least -ln(draw) / weight. A row of no weight is never taken."""
    keyed = rows.filter(F.col(weight) > 0).withColumn("_wait", -F.ln(F.greatest(uniform(seed, key), F.lit(2.0**-49))) / F.col(weight))
    return keyed.orderBy("_wait", key).limit(k).drop("_wait")


def datasets(pairs: DataFrame, pooled: DataFrame, negatives_of, share: float = TEST_SHARE, seed: int = SEED, regimes: tuple[str, ...] = ("R0", "R3")) -> DataFrame:
    """(regime, set_name, side, a, b, label): R0 and R3 with positives and each set of negatives.

    Positives are split once. ``negatives_of(positives, candidates)`` gives sets (set_name, a, b): for
    R0 from all entities, and each set is drawn to sides for itself; for R3 from the pool of a side."""
    positives = checkpointed(pairs.filter("label = 1").select("a", "b"))
    columns = ["regime", "set_name", "side", "a", "b", "label"]
    sided = lambda rows, label: rows.withColumn("label", F.lit(label)).withColumn("regime", F.lit("R0")).withColumn("side", F.when(uniform(seed, "label", "a", "b") < share, "test").otherwise("train"))
    out = sided(positives, 1).withColumn("set_name", F.lit("positives")).select(columns)
    if "R0" in regimes:
        made = checkpointed(negatives_of(positives, None).select("set_name", "a", "b"))
        out = out.union(sided(made, 0).select(columns))
    else:
        out = out.limit(0)
    placed = checkpointed(membership(positives, pooled))
    for side in ("train", "test") if "R3" in regimes else ():
        mine = placed.filter(F.col("membership") == f"both_{side}").select("a", "b")
        pool = pooled.filter(F.col("pool") == side).select("entity")
        both = mine.withColumn("set_name", F.lit("positives")).withColumn("label", F.lit(1)).select("set_name", "a", "b", "label").union(negatives_of(mine, pool).withColumn("label", F.lit(0)).select("set_name", "a", "b", "label"))
        out = out.union(both.withColumn("regime", F.lit("R3")).withColumn("side", F.lit(side)).select(columns))
    return out
