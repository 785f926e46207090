"""Toxicity behind a noisy channel: the decoder against all readings, scores on planted and held-out texts."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import toxicity

CLEAN = ["the", "river", "runs", "under", "seven", "bridges", "and", "nobody", "counts", "them", "classic", "hello", "letter", "window"]
BAD = ["idiot", "stupid", "moron", "worthless"]


def bits_by_hand(texts):
    """Interpolated bits from counts made with plain strings."""
    counts = [Counter() for _ in range(4)]
    for t in texts:
        s = "".join(chr(96 + c) if (c := toxicity._fold(x)) else "_" for x in t.lower() + " ")
        while "__" in s:
            s = s.replace("__", "_")
        s = "___" + s.lstrip("_").replace("_", "___")
        for i in range(3, len(s)):
            counts[3][s[i - 3:i + 1]] += 1
    for k in (2, 1, 0):
        for g, n in counts[k + 1].items():
            counts[k][g[1:]] += n

    def p(g):
        if not g:
            return 1 / 27
        own = {x: counts[len(g) - 1][g[:-1] + x] for x in "_abcdefghijklmnopqrstuvwxyz"}
        total, kinds = sum(own.values()), sum(v > 0 for v in own.values())
        return (own[g[-1]] + kinds * p(g[1:])) / (total + kinds) if total else p(g[1:])

    return p


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    rows = []
    for i in range(600):
        words = rng.choices(CLEAN, k=rng.randint(5, 30))
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark, corpus):
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in corpus], "doc_id bigint, text string, score string").repartition(3)
    return toxicity.train(docs, spark.createDataFrame([(i, 1, y) for i, _, y in corpus], "doc_id bigint, quality int, toxic int"))


def test_language_model_counts_all_texts(spark, odd_docs):
    texts = [t or "" for t in odd_docs.select("text").toPandas()["text"]] + ["Äpfel essen wir", "idiot!"]
    bits = toxicity.bits_of(toxicity.gram_counts(spark.createDataFrame([(t,) for t in texts], "text string"))).reshape((27,) * 4)
    p = bits_by_hand(texts)
    for g in ["___a", "__wo", "_wor", "word", "ord_", "apfe", "zzzz", "ere_", "idio"]:
        assert bits[tuple(0 if x == "_" else ord(x) - 96 for x in g)] == pytest.approx(-math.log2(p(g)))


def test_viterbi_equals_all_readings(model):
    """The best path of a lattice, by writing out every path."""
    bits = model.bits.tolist()

    def price(path):
        paid, context = 0.0, (0, 0, 0)
        for letter, cost in path:
            paid += cost
            if letter == " ":
                paid += bits[np.ravel_multi_index((*context, 0), (27,) * 4)] if any(context) else 0.0
                context = (0, 0, 0)
            elif letter:
                code = toxicity._fold(letter)
                paid += bits[np.ravel_multi_index((*context, code), (27,) * 4)]
                context = (*context[1:], code)
        return paid + (bits[np.ravel_multi_index((*context, 0), (27,) * 4)] if any(context) else 0.0)

    for token in ["1d10t", "h3ll0", "l-e-t", "seeeven", "$tup1d", "a b c", "c1a55ic", "w|n", "r!v3r", "x"]:
        best = min(itertools.product(*toxicity.lattice(token)), key=price)
        assert toxicity.restored(token, bits) == "".join(letter for letter, _ in best), token


@pytest.mark.parametrize("seen, word", [("1d10t", "idiot"), ("IDIOOOT!!", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("id*ot", "idiot"), ("$tup1d", "stupid"),
                                        ("m0r0n", "moron"), ("w-o-r-t-h-l-e-s-s", "worthless"), ("st_up_id", "stupid"), ("h3ll0", "hello"), ("cl@ssic", "classic")])
def test_disguised_words_are_restored(model, seen, word):
    reader = model.reader()
    assert word in reader.text(f"the river {seen} runs").split()
    toxic = word in BAD
    assert (model.score(reader.words(f"seven bridges {seen} and the river runs")) >= 0.5) == toxic


def test_plain_text_stays(model):
    text = "The river's letter-box, well: classic windows! (seven) L'été"
    assert toxicity.Reader(model.bits.tolist()).text(text) == text


def test_scores_of_odd_rows(spark, model, odd_docs, no_docs):
    out = toxicity.scored(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    base = model.score([])
    assert base < 0.5 and all(r.score == base for r in out if r.doc_id in (1, 2, 3))
    assert toxicity.scored(no_docs, model).isEmpty()


@pytest.mark.parametrize("labels, share", [([], 0.5), ([(1, 1)], 0.75), ([(1, 0), (2, None), (None, 1)], 0.25)])
def test_labels_of_one_class(spark, labels, share):
    docs = spark.createDataFrame([(1, "idiot"), (2, "river")], "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2))
    assert [r.score for r in toxicity.scored(docs, toxicity.train(docs, known)).collect()] == pytest.approx([share] * 2)


def test_held_out_labels_teach_nothing(spark, corpus):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id bigint, text string")
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    a, b = [toxicity.train(docs, spark.createDataFrame([(i, y ^ (flip and out(i))) for i, _, y in corpus], "doc_id bigint, toxic int")) for flip in (0, 1)]
    assert a.counts == b.counts and (a.slope, a.offset, a.empty) == (b.slope, b.offset, b.empty)


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = toxicity.checks.queries["op11_toxicity"](spark, sf).cache()
    assert out.count() == docs.count()
    rows = out.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    toxic, clean = [np.array([r.score for r in rows if r.toxic == k]) for k in (1, 0)]
    assert (toxic >= 0.5).mean() > 0.85 and (clean >= 0.5).mean() < 0.01
    assert np.mean(toxic[:, None] > clean) + np.mean(toxic[:, None] == clean) / 2 > 0.96
