"""Control negatives: pairs without a link, matched to the positives in some way.

Every set follows one contract. For each positive one end is kept (by a fair draw) and the other
replaced by an entity of the wanted stratum; an entity is rejected if it is either end, if the pair is
a known positive, or if the pair was already made. A positive gives no row only if no entity of its
stratum is left for it.

Draws are not scans of a stratum: its entities are numbered, so a draw is a number, found by an
equi-join. A round makes ``draws`` draws for each positive without a negative and keeps its first good
one; of equal pairs the least ticket wins, and the others go on to the next round. Nearly all first draws
are good, so the further ones of a round are made only for positives whose first one isn't.

Those that all rounds leave (ends that are linked to most of their stratum) search its complement: what
an end can't take are few intervals of numbers, those of its neighbours and of its cluster, whose
members have consecutive numbers. Between them the j-th free entity is known from running lengths, so
the open positives of one end get different free entities by one join, or are found to have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.functions.draws import below, ticket
from edgewright.operators.ranges import checkpointed, quantiles, running, scratch

SEED, DRAWS, ROUNDS = 42, 16, 4
#: How often a two-sided set redraws the end that it searches from, after all draws failed.
ENDS = 16
#: Positives of all seeds of a sweep that are served at once.
SWEPT = 1 << 22
#: The share of a set that one entity may stand in for before ``reuse`` says so.
REUSE = 0.02


def numbered(entities: DataFrame) -> DataFrame:
    """(entity, stratum, ...) with its number in the stratum, from 0 in the order of hashes, and ``size``;
    with a ``cluster``, the members of one in a stratum follow each other from ``cluster_start`` on, ``cluster_size`` of them."""
    hashed = entities.withColumn("hash", F.xxhash64("entity"))
    if "cluster" not in entities.columns:
        return running(hashed, ["stratum"], "hash", {"number": F.lit(1)}).withColumn("number", F.col("number") - 1).withColumnRenamed("all_number", "size").drop("hash")
    named = hashed.withColumn("named", F.coalesce(F.concat(F.lit("c"), F.col("cluster").cast("string")), F.lit("")))
    within = running(named, ["stratum", "named"], "hash", {"place": F.lit(1)})
    sizes = named.groupBy("stratum", "named").agg(F.count("*").alias("n")).withColumn("hash", F.xxhash64("named"))
    starts = running(sizes, ["stratum"], "hash", {"up": F.col("n")}).select("stratum", "named", (F.col("up") - F.col("n")).alias("cluster_start"), F.col("n").alias("cluster_size"), F.col("all_up").alias("size"))
    return within.join(starts, ["stratum", "named"]).withColumn("number", F.col("cluster_start") + F.col("place") - 1).drop("hash", "named", "place", "all_place")


class _Sets:
    """What the rounds of one set share: numbered entities, known pairs, and the pairs made so far."""

    def __init__(self, positives: DataFrame, entities: DataFrame, seed: int, both: bool, exclude_cluster: bool, candidates: DataFrame | None) -> None:
        self.seed, self.both, self.cluster = seed, both, exclude_cluster
        entities = checkpointed(entities)
        mine = entities.select("entity", "stratum", *(["cluster"] if exclude_cluster else []))
        self.pool = checkpointed(numbered(mine if candidates is None else mine.join(candidates.select("entity").distinct(), "entity", "left_semi")))
        self.sizes = checkpointed(self.pool.select("stratum", "size").distinct())
        self.known = checkpointed(positives.select("a", "b").distinct())
        self.made: DataFrame | None = None
        extra = ["cluster"] if exclude_cluster else []
        side = lambda x: entities.select(F.col("entity").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("stratum", *extra)))
        start = self.known.withColumn("keep_a", below(F.lit(2), seed, F.lit("side"), "a", "b") == 0)
        self.open = checkpointed(start.join(side("a"), "a").join(side("b"), "b"))

    def wanted(self) -> Column:
        """The stratum of the end that is replaced."""
        return F.when(F.col("keep_a"), F.col("stratum_b")).otherwise(F.col("stratum_a"))

    def sized(self, rows: DataFrame, stratum: Column, out: str) -> DataFrame:
        """With how many entities the wanted stratum has, once for each open positive."""
        return rows.withColumn("stratum", stratum).join(self.sizes.withColumnRenamed("size", f"size_{out}"), "stratum").withColumnRenamed("stratum", f"in_{out}")

    def member(self, tries: DataFrame, number: Column, out: str) -> DataFrame:
        extra = [F.col("cluster").alias(f"cluster_{out}")] if self.cluster else []
        members = self.pool.select(F.col("stratum").alias(f"in_{out}"), F.col("number").alias("number"), F.col("entity").alias(out), *extra)
        return tries.withColumn("number", number.cast("long")).join(members.withColumn("number", F.col("number").cast("long")), [f"in_{out}", "number"]).drop("number")

    def good(self, drawn: DataFrame) -> DataFrame:
        """(of_a, of_b, p): each positive's first good try."""
        kept = F.when(F.col("keep_a"), F.col("a")).otherwise(F.col("b"))
        x, y = (F.col("u"), F.col("v")) if self.both else (kept, F.col("u"))
        fine = x != y if self.both else (F.col("u") != F.col("a")) & (F.col("u") != F.col("b"))
        if self.cluster:
            fine = fine & ~F.col("cluster_u").eqNullSafe(F.when(F.col("keep_a"), F.col("cluster_a")).otherwise(F.col("cluster_b")))
        rows = drawn.filter(fine).select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), F.col("a").alias("of_a"), F.col("b").alias("of_b"), "try")
        rows = rows.join(self.known.toDF("x", "y"), ["x", "y"], "left_anti")
        if self.made is not None:
            rows = rows.join(self.made.select("x", "y"), ["x", "y"], "left_anti")
        return rows.groupBy("of_a", "of_b").agg(F.min_by(F.struct("x", "y"), "try").alias("p"))

    def keep(self, first: DataFrame) -> bool:
        """Takes each positive's first good try, if no other has it; whether there was one."""
        won = first.groupBy("p").agg(F.min_by(F.struct("of_a", "of_b"), F.struct(ticket(self.seed, "of_a", "of_b"), "of_a", "of_b")).alias("o"))
        new = checkpointed(won.select("p.x", "p.y", "o.of_a", "o.of_b"))
        if new.isEmpty():
            return False
        self.made = new if self.made is None else checkpointed(self.made.union(new))
        self.open = checkpointed(self.open.join(new.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), ["a", "b"], "left_anti"))
        return True

    def tries(self, ready: DataFrame, start: int, end: int, salt: str) -> DataFrame:
        rows = ready.withColumn("try", F.explode(F.sequence(F.lit(start), F.lit(end - 1))))
        for out in ("u", "v") if self.both else ("u",):
            rows = self.member(rows, below(F.col(f"size_{out}"), self.seed, F.lit(f"{salt}{out} number"), "a", "b", "try"), out)
        return rows

    def draw(self, rounds: int, draws: int, salt: str = "") -> None:
        for r in range(rounds):
            if self.open.isEmpty():
                return
            ready = self.sized(self.open, F.col("stratum_a") if self.both else self.wanted(), "u")
            ready = self.sized(ready, F.col("stratum_b"), "v") if self.both else ready
            first = checkpointed(self.good(self.tries(ready, r * draws, r * draws + 1, salt)))
            if draws > 1:
                rest = ready.join(first.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), ["a", "b"], "left_anti")
                first = first.union(self.good(self.tries(rest, r * draws + 1, (r + 1) * draws, salt)))
            self.keep(first)

    def neighbours(self, ends: DataFrame) -> DataFrame:
        """(x, entity): what ``ends`` (x) are linked to, by known pairs and by those made."""
        pairs = self.known.select(F.col("a").alias("p"), F.col("b").alias("q"))
        pairs = pairs if self.made is None else pairs.union(self.made.select("x", "y"))
        both = pairs.select(F.col("p").alias("x"), F.col("q").alias("entity")).union(pairs.select(F.col("q").alias("x"), F.col("p").alias("entity")))
        return both.join(ends.select("x").distinct(), "x", "left_semi").union(ends.select("x", F.col("x").alias("entity"))).distinct()

    def complement(self, asked: DataFrame, salt: str = "") -> DataFrame:
        """Tries for ``asked`` (a, b, x, in_u, ...), ends x that want an entity of stratum in_u: each row with
        a free entity ``u`` of its own among those that x may take; rows beyond the free ones get none."""
        cluster = ["cluster_x"] if self.cluster else []
        asked = checkpointed(asked.join(self.sizes.select(F.col("stratum").alias("in_u"), F.col("size").alias("size_u")), "in_u"))
        wanting = checkpointed(asked.select("x", "in_u", "size_u", *cluster).distinct())
        linked = self.neighbours(wanting).join(self.pool, "entity").withColumnRenamed("stratum", "in_u").join(wanting.select("x", "in_u", *cluster), ["x", "in_u"])
        single = linked.filter(~F.col("cluster").eqNullSafe(F.col("cluster_x"))) if self.cluster else linked
        taken = single.select("x", "in_u", F.col("number").alias("start"), F.lit(1).cast("long").alias("long"))
        if self.cluster:
            runs = self.pool.select(F.col("stratum").alias("in_u"), F.col("cluster").alias("of"), F.col("cluster_start").alias("start"), F.col("cluster_size").alias("long")).distinct()
            own = wanting.join(runs, (wanting["in_u"] == runs["in_u"]) & wanting["cluster_x"].eqNullSafe(runs["of"])).select("x", wanting["in_u"], "start", "long")
            taken = taken.union(own)
        gaps = running(taken, ["x", "in_u"], "start", {"up": F.col("long")}).select("x", "in_u", (F.col("start") - F.col("up") + F.col("long")).alias("ahead"), "long", F.col("all_up").alias("blocked"))
        gaps = checkpointed(gaps)  # ``ahead``: free entities before the interval
        blocked = gaps.groupBy("x", "in_u").agg(F.first("blocked").alias("blocked"))
        turn = running(asked.withColumn("turn", F.xxhash64(ticket(self.seed, F.lit(f"{salt}turn"), "a", "b"))), ["x", "in_u"], "turn", {"place": F.lit(1)})
        free = turn.join(blocked, ["x", "in_u"], "left").withColumn("free", F.col("size_u") - F.coalesce("blocked", F.lit(0))).filter("place <= free")
        j = (below(F.col("free"), self.seed, F.lit(f"{salt}start"), "x", "in_u") + F.col("place") - 1) % F.col("free")
        free = checkpointed(free.withColumn("j", j).select(*asked.columns, "j"))
        event = gaps.select("x", "in_u", (F.col("ahead") * 2).alias("at"), "long").union(free.select("x", "in_u", (F.col("j") * 2 + 1).alias("at"), F.lit(0).cast("long")))
        shift = running(event, ["x", "in_u"], "at", {"up": F.col("long")}).filter("at % 2 = 1").select("x", "in_u", F.expr("at div 2").alias("j"), "up").distinct()
        found = free.join(shift, ["x", "in_u", "j"])
        return self.member(found, F.col("j") + F.col("up"), "u").withColumn("try", F.lit(0)).drop("j", "up", "x")

    def search(self, salt: str = "") -> None:
        """Serves the open positives from the complement of what their kept ends are linked to; pairs that two
        ends found for each other are found again, until all that can be are served."""
        while not self.open.isEmpty():
            kept = F.when(F.col("keep_a"), F.col("a")).otherwise(F.col("b")).alias("x")
            extra = [F.when(F.col("keep_a"), F.col("cluster_a")).otherwise(F.col("cluster_b")).alias("cluster_x")] if self.cluster else []
            if not self.keep(self.good(self.complement(self.open.select("*", kept, self.wanted().alias("in_u"), *extra), salt))):
                return

    def search_from_draws(self) -> None:
        """For two-sided sets: an end drawn anew, and one of the other stratum that it isn't linked to."""
        for r in range(ENDS):
            if self.open.isEmpty():
                return
            drawn = self.member(self.sized(self.open, F.col("stratum_a"), "u"), below(F.col("size_u"), self.seed, F.lit("end"), "a", "b", F.lit(r)), "u")
            asked = drawn.withColumnRenamed("u", "v").drop("in_u", "size_u").withColumn("x", F.col("v")).withColumn("in_u", F.col("stratum_b"))
            self.keep(self.good(self.complement(asked, f"{r} ")))

    def rows(self, name: str) -> DataFrame:
        made = self.made if self.made is not None else self.known.limit(0).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("a").alias("of_a"), F.col("b").alias("of_b"))
        return made.select(F.lit(name).alias("set_name"), F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0).alias("label"), "of_a", "of_b")


def matched(positives: DataFrame, entities: DataFrame, name: str, seed: int = SEED, both: bool = False, exclude_cluster: bool = False, draws: int = DRAWS, rounds: int = ROUNDS, candidates: DataFrame | None = None) -> DataFrame:
    """(set_name, a, b, label, of_a, of_b): negatives for positives (a, b), with whom each is for.

    ``entities`` are (entity, stratum[, cluster]); only ``candidates`` (entity) stand in, if given;
    ``both`` redraws both ends, ``2 * draws * rounds`` times, and then one end ``ENDS`` times, for which the
    other is searched; ``exclude_cluster`` rejects an entity of the kept end's cluster, an unknown cluster
    being equal to another."""
    return _made(positives, entities, seed, both, exclude_cluster, draws, rounds, candidates).rows(name)


def _made(positives: DataFrame, entities: DataFrame, seed: int, both: bool, exclude_cluster: bool, draws: int, rounds: int, candidates: DataFrame | None) -> _Sets:
    sets = _Sets(positives, entities, seed, both, exclude_cluster, candidates)
    sets.draw(2 * rounds if both else rounds, draws)
    if both:
        sets.search_from_draws()
    else:
        sets.search()
    return sets


def exhausted(positives: DataFrame, entities: DataFrame, name: str, seed: int = SEED, exclude_cluster: bool = False, draws: int = DRAWS, rounds: int = ROUNDS, candidates: DataFrame | None = None) -> DataFrame:
    """(set_name, stratum, positives): for how many positives of the set that ``matched`` makes no entity of
    their stratum was left, by the stratum that was wanted."""
    sets = _made(positives, entities, seed, False, exclude_cluster, draws, rounds, candidates)
    return sets.open.groupBy(F.lit(name).alias("set_name"), sets.wanted().alias("stratum")).agg(F.count("*").alias("positives"))


def _next_free(sets: _Sets, asked: DataFrame, caliper: int | None) -> DataFrame:
    """``asked`` (x, wanted, ...) with ``in_u``, the nearest degree at which x may still take an entity; the
    lesser of two at one distance. Rows without any go.

    A degree is used up for x if x is linked to all its entities, so only degrees of x's neighbours can
    be. Degrees are numbered; used-up ones in a row form an island, and what lies beside it is next."""
    degrees = checkpointed(running(sets.sizes.select("stratum", "size"), [], "stratum", {"at": F.lit(1)}).select("stratum", "size", "at", F.col("all_at").alias("last")))
    linked = sets.neighbours(asked.select("x").distinct()).join(sets.pool.select("entity", "stratum"), "entity").groupBy("x", "stratum").agg(F.count("*").alias("held"))
    used = linked.join(degrees, "stratum").filter("held >= size").select("x", "at")
    island = running(used, ["x"], "at", {"place": F.lit(1)}).withColumn("island", F.col("at") - F.col("place"))
    ends = island.groupBy("x", "island").agg(F.min("at").alias("from"), F.max("at").alias("to"))
    beside = checkpointed(island.join(ends, ["x", "island"]).select("x", "at", (F.col("from") - 1).alias("below"), (F.col("to") + 1).alias("above")))
    placed = asked.join(around(degrees.select(F.col("stratum").alias("degree")), asked.select("wanted")), "wanted", "left")
    for side, at, beyond in (("low", "low_at", "below"), ("high", "high_at", "above")):
        placed = placed.join(degrees.select(F.col("stratum").alias(side), F.col("at").alias(at)), side, "left")
        moved = beside.select("x", F.col("at").alias(at), F.col(beyond).alias("_to"))
        placed = placed.join(moved, ["x", at], "left").withColumn(at, F.coalesce("_to", at)).drop("_to", side)
        placed = placed.join(degrees.select(F.col("at").alias(at), F.col("stratum").alias(side)), at, "left").drop(at)
    best = _nearer("wanted", "low", "high")
    found = placed.withColumn("in_u", best).filter("in_u IS NOT NULL").drop("low", "high")
    return found if caliper is None else found.filter(F.abs(F.col("in_u") - F.col("wanted")) <= caliper)


def _nearer(wanted: str, low: str, high: str) -> Column:
    below_, above = F.col(wanted) - F.col(low), F.col(high) - F.col(wanted)
    return F.when(F.col(high).isNull() | (below_ <= above), F.col(low)).otherwise(F.col(high))


def nearest(positives: DataFrame, entities: DataFrame, name: str, caliper: int | None = None, seed: int = SEED, candidates: DataFrame | None = None) -> DataFrame:
    """Like ``matched``, with the entity of nearest degree that is left; ``stratum`` is the degree.

    The lesser of two degrees at one distance comes first, none beyond ``caliper`` serves, and a degree
    is left only when the kept end may take no entity of it. A round serves each end's positives from
    the nearest free degrees; those beyond what such a degree has free go on to the next round."""
    sets, r = _Sets(positives, entities, seed, False, False, candidates), 0
    while not sets.open.isEmpty():
        kept = F.when(F.col("keep_a"), F.col("a")).otherwise(F.col("b")).alias("x")
        asked = _next_free(sets, sets.open.select("*", kept, sets.wanted().alias("wanted")), caliper)
        if not sets.keep(sets.good(sets.complement(asked, f"{r} "))):
            break
        r += 1
    return sets.rows(name)


def around(have: DataFrame, want: DataFrame) -> DataFrame:
    """(wanted, low, high): the nearest of the numbers ``have`` (degree) at or below, and at or above, each wanted one.

    A search among different numbers alone, from either side."""
    own = have.select(F.col("degree").alias("d")).distinct().withColumn("kind", F.lit(0))
    asked = want.select(F.col("wanted").alias("d")).distinct().withColumn("kind", F.lit(1))
    both = own.union(asked).groupBy("d").agg(F.max(F.when(F.col("kind") == 0, F.col("d"))).alias("own"), F.max("kind").alias("asked"))
    up = running(both, [], "d", least={"low": -F.col("own")}).withColumn("low", F.greatest(-F.col("low"), "own"))
    down = running(up, [], "d", least={"high": F.col("own")}, descending=True).withColumn("high", F.least("high", "own"))
    return down.filter("asked = 1").select(F.col("d").alias("wanted"), "low", "high")


def nearest_degree(entities: DataFrame, degrees_wanted: DataFrame, caliper: int | None = None) -> DataFrame:
    """(wanted, degree, distance): for each wanted degree the nearest degree that entities have.

    A search among different degrees alone, from either side: no entity is compared with another."""
    out = around(entities, degrees_wanted).select("wanted", _nearer("wanted", "low", "high").alias("degree")).withColumn("distance", F.abs(F.col("wanted") - F.col("degree")))
    return out if caliper is None else out.filter(F.col("distance") <= caliper)


def checks(negatives: DataFrame, positives: DataFrame, entities: DataFrame, exclude_cluster: bool = False) -> DataFrame:
    """(set_name, low, high, n, broken): negatives by the two strata of their ends, and how many break
    the contract: a self-pair, a known positive, a repeat, ends out of order, other strata than those of
    the positive, or the kept end's own cluster."""
    known = positives.select("a", "b").distinct().withColumn("known", F.lit(1))
    repeats = negatives.groupBy("set_name", "a", "b").agg(F.count("*").alias("times"))
    rows = negatives.join(repeats, ["set_name", "a", "b"]).join(known, ["a", "b"], "left")
    extra = ["cluster"] if exclude_cluster else []
    for x in ("a", "b", "of_a", "of_b"):
        rows = rows.join(entities.select(F.col("entity").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("stratum", *extra))), x, "left")
    of = F.array_sort(F.array("stratum_of_a", "stratum_of_b"))
    broken = (F.col("a") >= F.col("b")) | F.col("known").isNotNull() | (F.col("times") > 1) | (F.array_sort(F.array("stratum_a", "stratum_b")) != of)
    if exclude_cluster:
        broken = broken | F.col("cluster_a").eqNullSafe(F.col("cluster_b"))
    return rows.groupBy("set_name", of[0].alias("low"), of[1].alias("high")).agg(F.count("*").alias("n"), F.count_if(broken).alias("broken"))


def reuse(negatives: DataFrame, positives: DataFrame) -> DataFrame:
    """Per set: how often one entity stands in for others: how many do, the most, median and 95 %
    quantile of times, the most as a share of the set, and whether that is over ``REUSE``."""
    ends = negatives.select("set_name", F.explode(F.array_except(F.array("a", "b"), F.array("of_a", "of_b"))).alias("decoy"))
    n = checkpointed(ends.groupBy("set_name", "decoy").agg(F.count("*").alias("times")))
    most = n.groupBy("set_name").agg(F.count("*").alias("decoys"), F.max("times").alias("most"), F.sum("times").alias("rows"))
    q = quantiles(n, ["set_name"], "times", [0.5, 0.95], "q")
    return most.join(q, "set_name").select("set_name", "decoys", "most", F.round(F.col("q")[0], 6).alias("median"), F.round(F.col("q")[1], 6).alias("p95"), F.round(F.col("most") / F.col("rows"), 6).alias("most_share"), (F.col("most") / F.col("rows") > REUSE).alias("over_reused"))


def swept(positives: DataFrame, entities: DataFrame, name: str, seeds: list[int], then=lambda made: made) -> DataFrame:
    """``then`` of (seed, set_name, a, b, label, of_a, of_b): one set for each seed.

    A seed is a part of every id and stratum, so sets share rounds but no draw and no pair. As many seeds
    are made at once as keep ``SWEPT`` positives; what their rounds leave on disk goes before the next ones."""
    spark, positives, entities, out = positives.sparkSession, checkpointed(positives), checkpointed(entities), None
    own = lambda c: F.concat(F.col("seed"), F.lit("|"), F.lpad(F.col(c).cast("string"), 20, "0"))
    of_seed = F.element_at(F.create_map(*[x for i, s in enumerate(seeds) for x in (F.lit(str(s)), F.lit(i))]), F.col("seed"))
    kind = positives.schema["a"].dataType.simpleString()
    plain = lambda c: F.regexp_replace(F.substring_index(c, "|", -1), "^0+(?=.)", "").cast(kind).alias(c)
    many = max(1, SWEPT // max(1, positives.count()))
    for start in range(0, len(seeds), many):
        each = F.explode(F.array(*[F.lit(str(s)) for s in seeds[start : start + many]])).alias("seed")
        with scratch(spark) as kept:
            pairs = positives.select("*", each).select(own("a").alias("a"), own("b").alias("b"))
            pool = entities.select("*", each).select(own("entity").alias("entity"), (F.col("stratum") * len(seeds) + of_seed).alias("stratum"))
            made = matched(pairs, pool, name)
            rows = then(made.select(F.substring_index("a", "|", 1).cast("int").alias("seed"), "set_name", plain("a"), plain("b"), "label", plain("of_a"), plain("of_b")))
            block = kept(rows)
        out = block if out is None else out.union(block)
    return out
