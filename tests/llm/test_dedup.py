"""SimHash, decontamination and mixing against brute force."""

import collections
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import decontaminate, mixing, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(values, max_bits):
    """Smallest member reachable over pairs within max_bits, by trying all pairs."""
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    a = np.array(sorted(values), np.uint64)
    for i, v in enumerate(a):
        for w in a[i + 1:][np.bitwise_count(a[i + 1:] ^ v) <= max_bits]:
            x, y = find(int(v)), find(int(w))
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_simhash_query_by_brute_force(spark):
    rows = simhash.checks.queries["op9_simhash_near_duplicates"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    root = groups(set(fp.values()), 3)
    first = collections.defaultdict(list)
    for i, v in fp.items():
        first[root[v]].append(i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{v:016x}", min(first[root[v]])) for i, v in fp.items()}


@pytest.mark.parametrize("max_bits, bucket_rows", [(3, 512), (3, 16), (5, 64), (8, 512)])
def test_links_of_dense_clusters(spark, max_bits, bucket_rows):
    """Clusters in which everything is near everything, far larger than a bucket."""
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(120):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    values |= {rng.getrandbits(64) for _ in range(200)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fp bigint")
    edges = simhash.links(df, max_bits, bucket_rows=bucket_rows)
    assert edges.count() <= 40 * len(values)
    tree = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(edges).collect()}
    want = groups(values, max_bits)
    assert len({tree.get(v, v) for v in values}) == len(set(want.values()))
    assert all((tree.get(a, a) == tree.get(want[a], want[a])) for a in values)


def test_thresholds_keep_every_pair():
    pairs = [np.array([5.0, 50, 500, 5000, 50000] + [1e6] * 12), *[np.array([1.0, 10, 100, 1000, 10000] + [1e6] * 12)] * 3]
    for most in range(9):
        t = simhash.thresholds(pairs, [16] * 4, 1000, most)
        assert sum(x + 1 for x in t) == most + 1 and min(t) >= -1


def test_autocorrelation_counts_pairs(spark):
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(1 << 63, size=300, dtype=np.int64))
    df = spark.createDataFrame([(int(v),) for v in values], "fp bigint")
    group = [3, 8, 20, 21, 40, 50]
    got = simhash.candidate_pairs(df, [group])[0]
    part = simhash.extract(values.view(np.uint64), tuple(group))
    d = np.bitwise_count(part[:, None] ^ part[None, :])
    assert np.allclose(got, [(d <= t).sum() for t in range(7)])


def test_simhash_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs.withColumn("fp", F.lit(0)), 3, 3).collect()
    assert len(rows) == odd_docs.count()
    assert {r.id: r.fp % (1 << 64) for r in rows if r.id is not None} == {r.doc_id: plain_fingerprint(r.text) for r in odd_docs.collect() if r.doc_id is not None}
    assert {r.component for r in rows if r.fp == 0} == {1} and [r.component for r in rows if r.id is None] == [None]
    assert [r.component for r in rows if r.id == 6] == [6, 6]
    assert simhash.near_duplicates(no_docs, 3, 3).count() == 0


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000}


# ---- decontamination

ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon."


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_best_stretch_by_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        item, text = [rng.randrange(4) for _ in range(rng.randint(1, 7))], [rng.randrange(4) for _ in range(rng.randint(0, 12))]
        want = min(edits(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1))
        got = decontaminate.best_stretch(np.array(item, np.uint64), np.array(text, np.uint64), 99)
        assert got[0] == want and edits(item, text[got[1]:got[2]]) == want
        assert decontaminate.best_stretch(np.array(item, np.uint64), np.array(text, np.uint64), want - 1) is None


def test_decontamination_finds_passages(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "... !!"), (5, ITEM), (6, "one two")], "item_id bigint, text string")
    noise = " ".join(f"n{i}" for i in range(300))
    near = ITEM.replace("iota", "changed").replace("beta gamma", "beta extra gamma")
    far = " ".join(w if i % 4 else "x" for i, w in enumerate(ITEM.split()))
    docs = spark.createDataFrame([(1, f"{noise} {ITEM.upper()} {noise}"), (2, f"É {near}"), (3, noise), (4, far), (5, f"{ITEM}\n{noise}\n{ITEM}"), (6, None), (7, ""), (8, "zero one, TWO three")],
                                 "doc_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.find(docs, items).collect()}
    assert {i: sorted((m.item_id, m.edits) for m in r.matches) for i, r in got.items()} == {
        1: [(1, 0), (5, 0)], 2: [(1, 2), (5, 2)], 3: [], 4: [], 5: [(1, 0), (1, 0), (5, 0), (5, 0)], 6: [], 7: [], 8: [(6, 0)]}
    m = got[1].matches[0]
    assert got[1].text[m.start:m.end] + "." == ITEM.upper()
    assert got[8].text[got[8].matches[0].start:got[8].matches[0].end] == "one, TWO"
    assert decontaminate.find(odd_docs, items).count() == odd_docs.count() and decontaminate.find(no_docs, items).count() == 0
    assert decontaminate.find(docs.withColumn("matches", F.lit(1)), items.limit(0)).filter(F.size("matches") > 0).count() == 0
    blocks = decontaminate.find(docs, items, block=1)
    assert {r.doc_id: len(r.matches) for r in blocks.collect()} == {i: len(r.matches) for i, r in got.items()}


def test_decontamination_recall(spark):
    """Items with a tenth of their words edited, in the middle of other text, against the target."""
    rng = random.Random(4)
    items = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(12, 60))) for _ in range(60)]
    docs = []
    for n in range(300):
        words = items[n % 60].split()
        for _ in range(len(words) // 10):
            at = rng.randrange(len(words))
            words[at:at + 1] = [f"e{rng.randrange(99)}"] if rng.random() < 0.7 else []
        pad = [f"w{rng.randrange(3000)}" for _ in range(80)]
        docs.append((n, " ".join(pad[:40] + words + pad[40:])))
    docs += [(1000 + n, " ".join(f"w{rng.randrange(3000)}" for _ in range(200))) for n in range(100)]
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"))
    rows = found.select("doc_id", F.explode("matches").alias("m")).collect()
    hit = {r.doc_id for r in rows if r.doc_id < 1000 and r.m.item_id == r.doc_id % 60}
    assert len(hit) >= 0.85 * 300 and not [r for r in rows if r.doc_id >= 1000]


@pytest.mark.parametrize("low, high", [(10, 15), (16, 31), (32, 63), (64, 127), (128, 255), (256, 511), (512, 1023), (1024, 1500)])
def test_decontamination_recall_per_length(low, high):
    """The hardest allowed copies, floor(words / 10) random edits, in a table of mostly short items: each length reaches the target on its own."""
    rng = np.random.default_rng(low)
    short = [rng.integers(1 << 40, size=int(rng.integers(10, 16))).astype(np.uint64) for _ in range(300)]
    own = [rng.integers(1 << 40, size=int(rng.integers(low, high + 1))).astype(np.uint64) for _ in range(20)]
    idx = decontaminate.index(list(range(320)), own + short, decontaminate.plan(own + short))
    copies = [(i % 20, decontaminate.edited(own[i % 20], len(own[i % 20]) // 10, rng)) for i in range(120)]

    def text(words):
        return " ".join(names.setdefault(int(x), f"w{len(names)}") for x in words)

    names = {}  # words of letters instead of numbers, so that whole texts can be searched
    idx = decontaminate.index(idx.ids, [decontaminate.symbols_of([text(w)])[0] for w in idx.words], idx.walks)
    found = decontaminate.matches([text([*rng.integers(1 << 40, size=50), *words, *rng.integers(1 << 40, size=50)]) for _, words in copies], idx)
    assert all({m["item_id"] for m in own} <= {i} for (i, _), own in zip(copies, found, strict=True))
    # the plan aims at .9 or more; 120 trials at exactly .9 stay above .8 with probability .999
    assert np.mean([bool(x) for x in found]) >= (0.8 if high < 64 else 0.9)


def test_decontamination_plan_fails_loudly():
    with pytest.raises(ValueError, match="not found"):
        decontaminate.plan([np.arange(1, 40, dtype=np.uint64)], edit_rate=0.99, recall=1.1)


def test_decontamination_of_the_benchmark(spark):
    """Every item that stands in a document word for word is found, and nothing else than stretches within the limit."""
    got = {(r.doc_id, r.item_id) for r in decontaminate.checks.queries["op6_benchmark_decontamination"](spark, "/root/testdata/sf0.01").collect()}
    import re
    word = re.compile(r"[^\W_]+")
    texts = {r.doc_id: " " + " ".join(word.findall((r.text or "").lower())) + " " for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    items = {r.item_id: " " + " ".join(word.findall(r.text.lower())) + " " for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()}
    assert {(i, j) for i, t in texts.items() for j, x in items.items() if x in t} <= got
    assert len({i for i, _ in got}) < 0.1 * len(texts)


# ---- mixing


def check_mixture(rows, counts, weights, block_docs):
    assert sorted(collections.Counter(r.source or "" for r in rows).items()) == sorted(counts.items())
    assert len({r.position for r in rows}) == len(rows)
    at = {}
    for r in rows:
        assert r.release <= r.slot < r.deadline
        assert at.setdefault(r.slot, (r.source or "", r.block)) == (r.source or "", r.block)
    assert sorted(at) == list(range(len(at)))
    total, done = sum(weights.values()), collections.Counter()
    for slot in sorted(at):
        done[at[slot][0]] += 1
        assert all(abs(done[s] - w / total * (slot + 1)) < 1 + 0.01 * (slot + 1) for s, w in weights.items())
        if done[at[slot][0]] * block_docs >= counts[at[slot][0]]:
            break


def test_mixture(spark, no_docs):
    counts = {"a": 700, "b": 300, "c": 90, "": 41}
    rows = [(i, s or None, i) for i, s in enumerate(x for x, n in counts.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, slot int")
    weights = {"a": 2.0, "b": 5.0, "c": 1.0, "": 1.0}
    check_mixture(mixing.mix(docs, weights, block_docs=8).collect(), counts, weights, 8)
    check_mixture(mixing.mix(docs, block_docs=8, lanes=3).collect(), counts, {s: n ** 0.5 for s, n in counts.items()}, 8)
    assert mixing.mix(no_docs).count() == 0


def test_mixture_odd_rows(spark, odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and len({r.position for r in rows}) == len(rows)


def test_period_meets_all_windows():
    rng = random.Random(1)
    for n in (1, 2, 7, 40):
        k = mixing.quantised({str(i): rng.random() + 0.001 for i in range(n)}, 256)
        assert sum(k.values()) == 256 and min(k.values()) >= 1
        slots = mixing.one_period(k, 256)
        assert sorted(t for s in slots.values() for t in s) == list(range(256))
        for s, own in slots.items():
            for t in range(256):
                assert abs(sum(x <= t for x in own) - k[s] / 256 * (t + 1)) < 1
    with pytest.raises(ValueError):
        mixing.quantised(dict.fromkeys("abc", 1.0), 2)


@pytest.mark.parametrize("weights", [{"a": 0.7, "b": 0.29, "c": 0.01}, {"a": 0.999, "b": 0.0005, "c": 0.0005}, {"hot": 30.0, **{f"s{i}": 1.0 for i in range(40)}}, {"a": 2 ** 0.5, "b": 3 ** 0.5, "c": 7 ** 0.5}])
def test_schedule_keeps_the_given_weights(weights):
    """Less than one block from the exact share after every slot, over many times 1,024 slots."""
    from fractions import Fraction
    total = sum(map(Fraction, weights.values()))
    share = {s: Fraction(w) / total for s, w in weights.items()}
    plan = mixing.schedule({s: int(20_000 * w) + 10 for s, w in share.items()}, weights)
    order = sorted((int(t), s) for s, own in plan.items() for t in own[0])
    assert [t for t, _ in order] == list(range(len(order)))
    done, ended = dict.fromkeys(weights, 0), False
    for t, s in order:
        done[s] += 1
        assert ended or all(abs(done[x] - w * (t + 1)) < 1 for x, w in share.items())
        ended = ended or done[s] == plan[s].shape[1]
    assert all((own[1] <= own[0]).all() and (own[0] < own[2]).all() for own in plan.values())


def test_mixture_joins_its_schedule_without_broadcast(spark, monkeypatch):
    docs = spark.range(5000).selectExpr("id AS doc_id", "if(id % 10 = 0, 'b', 'a') AS source")
    want = {tuple(r) for r in mixing.mix(docs, block_docs=2).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 0)
    assert {tuple(r) for r in mixing.mix(docs, block_docs=2).collect()} == want and len({r[-1] for r in want}) == 5000
