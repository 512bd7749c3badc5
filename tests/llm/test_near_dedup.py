"""Near-dedup against brute force over all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from edgewright.llm import near_dedup

from .conftest import ordered, words


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows, most=2):
    fps = [plain_fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= most:
                    label[i] = label[j] = min(label[i], label[j])
    out = []
    for i, r in enumerate(rows):
        ids = [x[0] for x, k in zip(rows, label, strict=True) if k == label[i] and x[0] is not None]
        out.append((r[0], f"{fps[i]:016x}", min(ids, default=None)))
    return out


def test_components(docs, rows):
    assert ordered(near_dedup.near_dedup(docs).collect()) == ordered(brute(rows))


def test_links_within_bits(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = list(dict.fromkeys(base + [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (1, 2, 2, 3)]))
    reps = spark.createDataFrame([(i, near_dedup._signed(f)) for i, f in enumerate(fps)], "node long, fp long")
    label = list(range(len(fps)))
    for _ in range(6):
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin(fps[i] ^ fps[j]).count("1") <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    found = {r["node"]: r["component"] for r in near_dedup.components(near_dedup.links(reps)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == label


def test_components_of_long_paths(spark):
    rng = random.Random(3)
    order = rng.sample(range(100), 70)
    edges = list(zip(order, order[1:], strict=False)) + [(200 + i, 200) for i in range(1, 30)] + [(300, 300)]
    rng.shuffle(edges)
    found = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: min(order) for x in order} | {200 + i: 200 for i in range(30)}


def test_one_of_near_copies_stays(spark):
    rng = random.Random(2)
    originals = [words(rng, 120, "abcdefghijklmnop") for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(originals)]
    for i, t in enumerate(originals[:6]):
        w = t.split()
        w[60] = "changed"
        rows += [(100 + i, " ".join(w)), (200 + i, t.upper())]
    other = words(rng, 120, "qrstuvwxyz")
    rows += [(300, None), (301, ""), (None, originals[0]), (None, None), (3, originals[3]), (4, other), (None, "by itself"), (None, "by itself")]
    clash = {c: F.lit("own") for c in ("kept_id", "own_0", "own_2", "key", "id", "n", "bucket", "cell")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)
    for exact in (False, True):
        kept = near_dedup.keep_one(docs, exact)
        assert kept.columns == docs.columns
        assert ordered((r["doc_id"], r["text"]) for r in kept.collect()) == ordered([*enumerate(originals), (300, None), (4, other), (None, "by itself")])


def jaccard(s, t):
    s, t = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (s.split(), t.split()))
    return len(s & t) / len(s | t)


def changed_copies(rng, text):
    """Copies with passages added at either end, words replaced, and passages in another order."""
    w, n = text.split(), len(text.split())
    new = lambda k: words(rng, k, "qrstuvwxyz").split()
    swap = lambda share: [rng.choice(new(1)) if rng.random() < share else x for x in w]
    made = [w + new(int(n * x)) for x in (0.05, 0.1, 0.15, 0.2, 0.3)] + [new(int(n * x)) + w for x in (0.05, 0.1, 0.2)]
    made += [swap(x) for x in (0.01, 0.02, 0.03, 0.05, 0.08)] + [w[n // 2 :] + w[: n // 2], rng.sample(w, n)]
    return [" ".join(x) for x in made]


def kept_by_brute_force(rows, similarity=0.8):
    label = list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= similarity]
    for _ in rows:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return sorted(rows[i][0] for i in range(len(rows)) if label[i] == i)


@pytest.mark.parametrize("exact", [False, True])
def test_all_pairs_of_the_rule_are_linked(spark, exact):
    """The copies of 0.8 or more of each original go, however they came about."""
    rng = random.Random(11)
    rows = []
    for n in (40, 100, 400):
        for _ in range(4):
            text = words(rng, n, "abcdefghijklmnop")
            rows += [(len(rows) + i, t) for i, t in enumerate([text, *(t for t in changed_copies(rng, text) if jaccard(text, t) >= 0.8)])]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), exact)
    assert sorted(r["doc_id"] for r in kept.collect()) == kept_by_brute_force(rows) and len(kept_by_brute_force(rows)) == 12


def test_fingerprints_link_near_copies_by_themselves(spark, monkeypatch):
    """Without bands, copies within two bits of 0.8 or more go; farther ones, and those below 0.8, stay."""
    monkeypatch.setattr(near_dedup, "_candidates", lambda reps: reps.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0))
    rng, rows, want, kinds = random.Random(31), [], [], Counter()
    bits = lambda s, t: bin(plain_fingerprint(s) ^ plain_fingerprint(t)).count("1")
    for i in range(300):
        text = words(rng, 200, "abcdefghijklmnop")
        w = text.split()
        for at in rng.sample(range(200), rng.choice((1, 1, 2, 12))):
            w[at] = "changed"
        copy = " ".join(w)
        gone = bits(text, copy) <= 2 and jaccard(text, copy) >= 0.8
        kinds[bits(text, copy) <= 2, jaccard(text, copy) >= 0.8] += 1
        rows += [(2 * i, text), (2 * i + 1, copy)]
        want += [2 * i] if gone else [2 * i, 2 * i + 1]
    rows += [(900, "a b c d e"), (901, "a b c d e a b c d e a b c d e")]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kinds[True, True] > 5 and kinds[False, True] > 5
    assert sorted(r["doc_id"] for r in kept.collect()) == [*want, 900, 901]


def test_nothing_below_the_rule_is_dropped(spark):
    """Each copy and its original alone: of those just below 0.8, both stay."""
    rng = random.Random(12)
    rows = []
    for n in (40, 100, 400):
        for _ in range(4):
            for k in range(len(changed_copies(random.Random(0), "a b"))):
                text = words(rng, n, "abcdefghijklmnop")
                rows += [(len(rows), text), (len(rows) + 1, changed_copies(rng, text)[k])]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [r for i in range(0, len(rows), 2) for r in kept_by_brute_force(rows[i : i + 2])]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_recall_on_the_given_documents(spark):
    """Of pairs of 0.8 or more whose shingles aren't all equal, nine in ten at least end together."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    reps, links = near_dedup.similar(docs)
    component = {r["node"]: r["component"] for r in near_dedup.components(links).collect()}
    by_key, shared = {}, {}
    for r in docs.collect():
        tokens = near_dedup.tokens_of(r["text"])
        by_key[near_dedup.key_of(tokens)] = set(near_dedup.shingles(tokens).tolist())
    for key, held in by_key.items():
        for h in held:
            shared.setdefault(h, []).append(key)
    meet = Counter((a, b) for keys in shared.values() if len(keys) < 400 for i, a in enumerate(keys) for b in keys[:i])
    near = [(a, b) for (a, b), n in meet.items() if 9 * n >= 4 * (len(by_key[a]) + len(by_key[b])) and by_key[a] != by_key[b]]
    found = sum(component.get(a, a) == component.get(b, b) for a, b in near)
    assert len(near) >= 5 and found >= 0.9 * len(near)
    assert {r["key"] for r in reps.collect()} == set(by_key)


@pytest.mark.parametrize("cell", [2048, 8])
def test_a_large_group_around_one_text(spark, monkeypatch, cell):
    """Copies that are near one text, and not each other, all go; so they do where buckets are dealt out."""
    monkeypatch.setattr(near_dedup, "CELL", cell)
    rng = random.Random(21)
    base = words(rng, 200, "abcdefghijklmnop").split()
    rows = [(0, " ".join(base))]
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(200), 4):
            w[at] = "".join(rng.choice("qrstuvwxyz") for _ in range(6))
        rows.append((i + 1, " ".join(w)))
    assert kept_by_brute_force(rows) == [0]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(kept.collect()) <= 4


def test_pivots_discard_pairs_before_they_are_formed():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    near = fps[:200] ^ np.uint64(5)
    every = np.concatenate([fps, near])
    tally = [0, 0]
    i, j = near_dedup.linked(every, np.zeros((len(every), 2), np.int64), 2, tally)
    assert {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist(), strict=True)} >= {(k, 3000 + k) for k in range(200)}
    pairs = len(every) * (len(every) - 1) // 2
    assert tally[0] < 0.45 * pairs and tally[1] < 1e-3 * pairs


def test_texts_over_a_chunk(spark, monkeypatch):
    """Fingerprints don't depend on where chunks end."""
    text = words(random.Random(6), 900)
    whole = near_dedup.fingerprint(text)
    for chunk in (1, 7, 128, 897, 898, 899):
        monkeypatch.setattr(near_dedup, "CHUNK", chunk)
        assert near_dedup.fingerprint(text) == whole == plain_fingerprint(text)


def test_empty(no_docs):
    assert near_dedup.near_dedup(no_docs).count() == 0
    assert near_dedup.keep_one(no_docs).count() == 0
