"""Verified near-duplicate groups against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import neardup

DOCS = "doc_id bigint, text string"


def exact_groups(texts):
    """Components of the pairs of similarity 0.8, by trying all pairs of shingle sets built from strings."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(b" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = set()
    order = sorted(texts)
    for x, i in enumerate(order):
        for j in order[x + 1:]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (a == b or len(a & b) >= 0.8 * len(a | b)):
                pairs.add((i, j))
                root[find(j)] = find(i)
    return pairs, {i: find(i) for i in texts}


def group_ids(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), DOCS).repartition(3)
    found = neardup.groups_of(docs, "doc_id")
    node = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"))
    return {r.doc_id: r.root for r in node.join(found, "node").collect()}


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_groups_against_all_pairs(spark):
    """Copies at every similarity around 0.8 and long texts with incomplete sketches: nearly all links, and no group without one."""
    rng = random.Random(8)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 5000}"
    texts = {}
    for k in range(120):
        base = [word() for _ in range(rng.choice([6, 30, 90, 400]))]
        for c in range(rng.choice([1, 2, 4])):
            own = edited(base, rng, rng.randint(0, max(1, len(base) // 35))) if c else base
            texts[len(texts)] = " ".join(own).upper() if rng.random() < 0.1 else " ".join(own)
    texts |= {1000: None, 1001: "", 1002: " \n\t", 1003: "one", 1004: "ONE", 1005: texts[0]}
    got = group_ids(spark, texts)
    pairs, want = exact_groups(texts)
    assert len(got) == len(texts)
    caught = sum(got[a] == got[b] for a, b in pairs)
    assert caught >= 0.95 * len(pairs) and len(pairs) > 100
    # every group is connected by exact links
    for root in set(got.values()):
        members = [i for i in texts if got[i] == root]
        assert len({want[i] for i in members}) == 1
    assert got[1000] == got[1001] == got[1002] and got[1003] == got[1004] and got[1005] == got[0]


def test_short_unrelated_texts_stay_apart(spark):
    """Thirty thousand texts of six words without a word in common."""
    texts = {i: " ".join(f"w{6 * i + k}" for k in range(6)) for i in range(30_000)}
    assert len(set(group_ids(spark, texts).values())) == len(texts)


def test_dense_group_is_proposed_once(spark, monkeypatch):
    """One group of near copies, larger than a bucket: few proposals, one group."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(800)}" for _ in range(200)]
    texts = {i: " ".join(edited(base, rng, rng.randint(0, 2))) for i in range(1500)}
    seen = []
    own = neardup.passing
    monkeypatch.setattr(neardup, "passing", lambda pairs, nodes: (seen.append(pairs.count()), own(pairs, nodes))[1])
    monkeypatch.setattr(neardup, "BUCKET_ROWS", 200)
    got = group_ids(spark, texts)
    assert sum(seen) < 12 * len(texts)
    assert len(set(got.values())) <= len(set(exact_groups(texts)[1].values())) + 2


def test_nearest_joins_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        centre = rng.integers(1 << 63, size=4, dtype=np.uint64)
        fp = centre[rng.integers(4, size=n)] ^ (np.uint64(1) << rng.integers(64, size=n).astype(np.uint64))
        mark = fp ^ (np.uint64(7) << rng.integers(61, size=n).astype(np.uint64))
        key, label, node, size = np.sort(rng.integers(3, size=n)), rng.integers(6, size=n), np.arange(n), rng.integers(80, 120, size=n)
        close = [(i, j) for i in range(n) for j in range(i + 1, n) if key[i] == key[j] and label[i] != label[j] and int(np.bitwise_count(fp[i] ^ fp[j])) <= neardup.MAX_BITS
                 and int(np.bitwise_count(mark[i] ^ mark[j])) <= neardup.MARK_BITS and min(size[i], size[j]) >= 0.8 * max(size[i], size[j])]

        def parts(edges, n=n, key=key, label=label):
            up = {(k, x): (k, x) for k, x in zip(key, label, strict=True)}

            def find(v):
                while up[v] != v:
                    v = up[v]
                return v

            for i, j in edges:
                a, b = find((key[i], label[i])), find((key[j], label[j]))
                up[max(a, b)] = min(a, b)
            return {v: find(v) for v in up}

        a, b = neardup.nearest_joins(key, node, fp, mark, size, label)
        chosen = list(zip(a.tolist(), b.tolist(), strict=True))
        assert set(chosen) <= set(close) and parts(chosen) == parts(close)
        assert len(chosen) <= len({(k, x) for k, x in zip(key, label, strict=True)})


def test_groups_of_odd_rows(spark, odd_docs, no_docs):
    found = neardup.groups_of(odd_docs.withColumn("node", F.lit(1)), "doc_id").collect()
    assert len(found) == odd_docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert neardup.groups_of(no_docs, "doc_id").isEmpty()


def test_stages_hand_clashing_columns_on(spark, sf):
    """Columns named like an operator's results keep their values through every stage but the last."""
    import corpus_pipeline as pipeline

    names = ["score", "lang_pred", "bits_per_byte", "matches", "spans", "blob", "_key", "_node", "node", "fp", "sketch", "_column0"]
    some = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40)
    docs = some.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name


def test_prefixes_lose_no_pair(spark):
    """Pairs whose fingerprints say nothing, texts longer than a sketch and often used shingles: every pair of similarity 0.8 shares a group."""
    rng = random.Random(11)
    line = [f"common{k}" for k in range(12)]
    texts = {}
    for k in range(260):
        base = [f"w{rng.randrange(10**7)}" for _ in range(rng.choice([12, 40, 300, 1200]))] + line
        for c in range(3):
            # near the limit: one edit breaks five shingles
            own = edited(base, rng, max(1, round(len(base) / 45)) if c else 0)
            texts[len(texts)] = " ".join(own)
    got = group_ids(spark, texts)
    pairs, want = exact_groups(texts)
    assert len(pairs) > 200 and all(got[a] == got[b] for a, b in pairs)
    assert len(set(got.values())) == len(set(want.values()))


def test_sketch_bound_is_never_below_the_similarity():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(150, 900))
        a = rng.integers(1 << 62, size=n, dtype=np.uint64)
        b = np.concatenate([a[:int(n * rng.random())], rng.integers(1 << 62, size=int(rng.integers(1, n)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        low = [np.unique((x[:neardup.SKETCH] >> np.uint64(32)).astype("<u4")) for x in (a, b)]
        _estimate, bound, exact = neardup.sketch_similarity(*low, len(a), len(b))
        assert bound >= neardup.similarity(a, b) - 1e-9 and (not exact or abs(bound - neardup.similarity(a, b)) < 1e-9)


def test_unlinked_relatives_propose_few_pairs(spark, monkeypatch):
    """A group of texts that share most of their shingles without a link: the pairs that meet sketches do not grow with its square."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = {i: " ".join(edited(base, rng, 4)) for i in range(400)}
    seen = []
    own = neardup.passing
    monkeypatch.setattr(neardup, "passing", lambda pairs, nodes: (seen.append(pairs.count()), own(pairs, nodes))[1])
    got = group_ids(spark, texts)
    assert sum(seen) < 4 * len(texts)
    assert len(set(got.values())) == len(set(exact_groups(texts)[1].values()))


def test_bounds_hold_for_every_link():
    """Sets of similarity 0.8: the parities differ in few enough bits, the prefixes share enough hashes."""
    rng = np.random.default_rng(9)
    often = rng.random(neardup.CELLS) < 0.05
    tight = 0
    for _ in range(600):
        n = int(rng.integers(1, 1500))
        a = np.unique(rng.integers(1 << 62, size=n, dtype=np.uint64))
        kept = a[rng.permutation(n)[:max(1, int(n * rng.uniform(0.8, 1)))]]
        b = np.unique(np.concatenate([kept, rng.integers(1 << 62, size=int(n * rng.uniform(0, 0.2)), dtype=np.uint64)]))
        if neardup.similarity(a, b) < neardup.JACCARD:
            continue
        sizes = np.array([len(a)]), np.array([len(b)])
        bits = np.frombuffer(neardup.parities(a) + neardup.parities(b), "<u8").reshape(2, -1)
        assert 9 * neardup.apart(bits, np.array([0]), np.array([1]))[0] <= len(a) + len(b)
        both = len(np.intersect1d(neardup.prefix(a, often), neardup.prefix(b, often)))
        assert both >= neardup.shared(*sizes)[0] >= 1
        tight += neardup.shared(*sizes)[0] > 1
    assert tight > 100


def test_only_often_used_cells_reach_the_driver(spark, monkeypatch, no_docs):
    """Counts of all cells as pickled rows took the driver's heap many times their size."""
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(40)) + " a line that every text repeats") for i in range(60)]
    docs = spark.createDataFrame([*texts, (60, None), (61, "")], DOCS).repartition(3)
    kind, arrow, collect, rows = type(docs), type(docs).toArrow, type(docs).collect, []

    def pickled(self, *args):
        out = collect(self)
        assert len(out) <= 1, "a table reached the driver as pickled rows"
        return out

    def seen(self):
        out = arrow(self)
        rows.append(out.num_rows)
        return out

    monkeypatch.setattr(kind, "toPandas", pickled)
    monkeypatch.setattr(kind, "collect", pickled)
    monkeypatch.setattr(kind, "toArrow", seen)
    got = neardup.often_used(docs)
    every = np.concatenate([neardup.shingles(t) for _, t in [*texts, (60, None), (61, "")]])
    n = np.bincount((every % np.uint64(neardup.CELLS)).astype(np.int64), minlength=neardup.CELLS)
    want = n > neardup.OFTEN * n.sum() / neardup.CELLS + neardup.MORE
    assert (got == want).all() and want.sum() and sum(rows) == want.sum()
    assert not neardup.often_used(no_docs).any()


def test_stored_bounds_the_batches_of_texts(spark):
    """Python workers get small batches while a table of texts is written, and the session's setting comes back."""
    import pyarrow as pa

    from barloom.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    rows = spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n long")
    before = spark.conf.get(common.ARROW_ROWS)
    assert max(r.n for r in common.stored(rows, "sizes", 100).collect()) == 100
    assert spark.conf.get(common.ARROW_ROWS) == before
    assert max(r.n for r in common.stored(rows, "sizes").collect()) == 1000
