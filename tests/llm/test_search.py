"""Lexical search and spelling variants against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import lexical, spelling

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(AZ))


def ranked(items, docs, top):
    own = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in own:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in Counter(terms(text)).items() if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


ITEMS = "item_id bigint, text string"
DOCS = "doc_id bigint, text string, score string, rank int"


@pytest.mark.parametrize("seed_docs, block_terms", [(10**9, 10**9), (20, 60)])
def test_search_by_brute_force(spark, seed_docs, block_terms):
    """Many ties, few words, several blocks, pruning from seeds."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(30)] + ["É", "é", "straße", "漢字", "A1", "a1"]
    text = lambda n: " -".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(i, text(rng.choice([1, 2, 5, 40]))) for i in range(400)] + [(None, text(9)), (None, None), (401, ""), (402, " ;;\n"), (7, text(4)), (7, text(4))]
    items = [(i, text(rng.choice([1, 3, 8]))) for i in range(40)] + [(None, "w1 w1 w2"), (90, None), (91, ""), (92, "unknown"), (3, text(5)), (3, text(6))]
    got = lexical.search(spark.createDataFrame(items, ITEMS), spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).repartition(3), 5, block_terms, seed_docs)
    assert found(got) == ranked(items, docs, 5)


def test_search_of_empty_tables(spark, odd_docs, no_docs):
    some, none = spark.createDataFrame([(1, "same row word1")], ITEMS), spark.createDataFrame([], ITEMS)
    assert lexical.search(none, odd_docs).isEmpty() and lexical.search(some, no_docs).isEmpty()
    rows = odd_docs.select("doc_id", "text").collect()
    assert found(lexical.search(some, odd_docs)) == ranked([(1, "same row word1")], [tuple(r) for r in rows], 20)


def test_pruning_leaves_few_pairs():
    """Documents on other subjects than an item are left in batches."""
    rng = random.Random(5)
    subject = lambda s, n: " ".join(f"s{s}w{rng.randrange(40)}" for _ in range(n)).encode()
    block = lexical.Block.of([(i, subject(i % 20, 8)) for i in range(60)])
    docs = [lexical.terms_of(subject(rng.randrange(20), 30)) for _ in range(2000)]
    vecs = [Counter(block.vocabulary[t] for t in d if t in block.vocabulary) for d in docs]
    block.weigh(len(docs), sum(map(len, docs)), Counter(c for v in vecs for c in v), 5)
    rows = [(np.array(sorted(v)), block.impact(30, np.array([v[c] for c in sorted(v)]))) for v in vecs]
    kept = [i for i, (c, _) in enumerate(rows) if len(c)]
    search = lexical.Search(block, 5)
    search.batch(kept, [rows[i] for i in kept])
    assert search.scored < len(kept) * len(block.ids) / 5
    weight = [{c: k * int(block.weights[c]) for c, k in own.items()} for own in block.counts]
    for w, heap in zip(weight, search.best, strict=True):
        every = sorted((-sum(w.get(int(c), 0) * int(x) for c, x in zip(*rows[i], strict=True)), i) for i in kept)
        assert sorted((-s, d) for s, _, d in heap) == [e for e in every[:5] if e[0] < 0]


# ---- spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(counts, ratio=5):
    forms, out = {}, {}
    for w, n in counts.items():
        own = sorted((-counts[v], v) for v in counts if near(w, v))
        forms[w] = own[0][1] if own and -own[0][0] >= ratio * n else None
        out[w] = (n, len(own))
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] += (forms[w], counts.get(forms[w]), root)
    return out


@pytest.mark.parametrize("symbols, letters", [(8, "abcdefgé"), (2, "abc"), (4, "aàâbcdßz")])
def test_variants_by_brute_force(spark, symbols, letters):
    rng = random.Random(symbols)
    words = {"".join(rng.choices(letters, k=rng.choice([1, 2, 6, 7, 8]))) for _ in range(250)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa"}
    for w in list(words)[:120]:
        k = rng.randrange(len(w))
        words |= {w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]}
    counts = {w: 5 ** rng.randrange(6) + rng.randrange(2) for w in words}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), symbols=symbols)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()} == grouped(counts)


def test_codes_cover_near_reduced_words():
    """Reduced words one edit apart meet from one side."""
    for k in range(1, 5):
        for a in itertools.product((1, 2, 3), repeat=k):
            home, codes = spelling.reduced_codes(np.array(a), 3)
            for i in range(k):
                for s in range(a[i] + 1, 4):
                    assert spelling.reduced_codes(np.array(a[:i] + (s,) + a[i + 1:]), 3)[0] in codes
                if k > 1:
                    assert spelling.reduced_codes(np.array(a[:i] + a[i + 1:]), 3)[0] in codes


def test_vocabulary_counts_whole_texts(spark, odd_docs, no_docs):
    texts = [(i, t) for i, t in odd_docs.select("doc_id", "text").collect()] + [(10 + k, "Größe wörtlich WORTLICH x" * 40) for k in range(30)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id bigint, text string, word string")
    want = Counter()
    for i, t in texts:
        for run, n in Counter(re.findall("[a-zÀ-ÿ]+", (t or "").translate(AZ))).items():
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += n
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert {r.word: r.n for r in spelling.vocabulary(docs).collect()} == want
    assert spelling.variants(spelling.vocabulary(no_docs)).isEmpty()


def test_queries_return_every_row(spark):
    sf = "/root/testdata/sf0.001"
    assert spark.read.parquet(f"{sf}/benchmark.parquet").count() == lexical.checks.queries["op13_lexical_search"](spark, sf).filter(F.col("rank") == 1).count()
