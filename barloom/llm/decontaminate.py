"""Benchmark decontamination by CGK embedding, bit sampling and exact verification.

Texts and items are sequences of words of the lower-cased text: runs of letters, digits and characters beyond ASCII. The CGK walk embeds a sequence: at step j it
writes the word under its pointer, and a random bit of (step, word) tells whether the pointer moves on. Sequences at a small edit
distance give walks that meet again after each edit, so edit distance turns into Hamming distance.

Every word of every text starts a window for each size class of items (sizes within a factor of two, up to ``ANCHOR_STEPS``). The walk of a window takes as many
steps as its class says, so it never leaves an item. An item is entered at anchors: its pieces of that many words, one after the other, and its last words; so a long
item has many chances, and edits in one piece leave the others alone. Bit sampling hashes ``SAMPLES`` random steps of the walk; windows
that share a hash with an anchor in any of the repetitions (independent walks, each sampled ``SAMPLINGS`` times) are candidates for the place where the item would start. ``plan`` measures
on the items themselves, with random edits at the allowed rate, how often they hit, for each factor of two of their lengths on its own, and takes as many walks for a
class as bring each of its lengths to ``RECALL``.

Each candidate is verified exactly: the least number of word edits between the item and any stretch of the text near the window
must be at most ``EDIT_RATE`` of the item's words. Items are the query set; they are taken in blocks of ``BLOCK_ITEMS``, so what is broadcast
is bounded, and a pass over the texts is made per block. A text is handled on its own in Arrow batches: no shuffle.

Defined results: null or empty text has no match; null, empty and wordless items match nothing; equal items each match; a text that holds an item
several times has a match per place; repeated rows are each examined. Columns named like an output column are replaced. Empty tables give no match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.checks.registry import Checks
from barloom.llm.common import sliced, table

checks = Checks()

# letters, digits and all bytes of characters beyond ASCII
IN_WORD = np.array([chr(b).isalnum() or b >= 0x80 for b in range(256)])
EDIT_RATE = 0.1
RECALL = 0.9
SAMPLES = 4
SAMPLINGS = 4
ANCHOR_STEPS = 32
BLOCK_ITEMS = 20_000
WINDOWS = 1 << 13
WALKS_TRIED = 256  # no plan needs so many: more is an error, not a lower recall
BITMAP_BITS = 18  # so many bits of a hash index its bitmap, more if there are many anchors
MATCH = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"


def symbols_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Word codes of all texts one after the other, the end of each text among them, its bytes, and each word's first and last byte.

    A code is the polynomial sum of a word's bytes modulo 2^64, taken from running sums over all bytes.
    """
    raw = [(t or "").lower().encode("utf-8") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = np.concatenate([[False], IN_WORD[data]])
    first, last = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    if len(first) > len(last):  # cannot be: the joined bytes end with a space
        raise ValueError("open word")
    n = len(data) + 1
    power = _powers(1 << (n - 1).bit_length())
    total = np.zeros(n, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[0][:n - 1], out=total[1:])
    codes = mixed((total[last] - total[first]) * power[1][first], 0)
    stops = np.cumsum([len(r) + 1 for r in raw])
    return codes, np.searchsorted(first, stops), raw, first, last


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i modulo 2^64."""
    p = 0x9E3779B97F4A7C15
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)])) for x in (p, pow(p, -1, 1 << 64)))


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64 pseudo-random bits per symbol."""
    z = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def size_class(words: int) -> int:
    """The largest power of two that is not above ``words``."""
    return 1 << (words.bit_length() - 1)


def steps_of(words: int) -> int:
    """The steps of the walks for an item."""
    return min(size_class(words), ANCHOR_STEPS)


def anchors(words: int) -> list[int]:
    """Where walks start in an item: piece after piece, and so that the last one ends with the item."""
    steps = steps_of(words)
    return sorted({*range(0, words - steps + 1, steps), words - steps})


@lru_cache(maxsize=None)
def sampled_steps(steps: int, repetition: int, samples: int) -> list[int]:
    rng = np.random.default_rng([steps, repetition])
    return sorted(int(x) for x in rng.choice(steps, size=min(samples, steps), replace=False))


def hashes(symbols: np.ndarray, starts: np.ndarray, sizes: list[int], walk: int, samples: int) -> dict[tuple[int, int], np.ndarray]:
    """For each sampling of the walk and size class the hash of the sampled steps from each start.

    ``symbols`` reaches max(sizes) beyond every start.
    """
    wanted: dict[int, list[tuple[int, int]]] = {}
    for size in sizes:
        for k in range(SAMPLINGS):
            for step in sampled_steps(size, walk * SAMPLINGS + k, samples):
                wanted.setdefault(step, []).append((k, size))
    out = {(k, size): np.full(len(starts), size, np.uint64) for k in range(SAMPLINGS) for size in sizes}
    at, prime = starts.astype(np.int64), np.uint64(0x9FB21C651E98DF25)
    for step in range(max(wanted) + 1):
        if step % 64 == 0:  # one row of bytes per eight steps, one column per word
            rows = np.ascontiguousarray(mixed(symbols, 1 + walk * 1024 + step // 64).view(np.uint8).reshape(-1, 8).T)
        if step in wanted:
            word = symbols[at]
            for key in wanted[step]:
                out[key] ^= word
                out[key] *= prime
        at += ((rows[step % 64 // 8] >> (step % 8)) & 1).astype(np.int64)[at]
    return out


@dataclass
class Index:
    """Items of a block with, per walk, sampling and size class, the sorted hashes of their anchors, whose and where these are, and a bitmap over high hash bits."""

    ids: list[int]
    words: list[np.ndarray]
    kinds: list[set[int]]
    sizes: list[int]
    walks: dict[int, int]
    samples: int
    edit_rate: float
    tables: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.uint64]]

    def candidates(self, symbols: np.ndarray, ends: np.ndarray, first_walk: int = 0) -> Iterator[tuple[int, int, int]]:
        """(start, item, text): where an item would start, maybe before its text; each once per block of windows."""
        count = int(ends[-1])
        for low in range(0, count, WINDOWS):
            n = min(WINDOWS, count - low)
            near = symbols[low:low + n + self.sizes[-1]]
            found: set[tuple[int, int, int]] = set()
            for walk in range(first_walk, max(self.walks.values())):
                for (k, size), h in hashes(near, np.arange(n), [s for s in self.sizes if self.walks[s] > walk], walk, self.samples).items():
                    keys, items, offsets, bitmap, shift = self.tables[walk, k, size]
                    hit = np.flatnonzero(bitmap[(h >> shift).view(np.int64)])
                    if len(hit):
                        left, right = np.searchsorted(keys, h[hit], "left"), np.searchsorted(keys, h[hit], "right")
                        some = right > left
                        for w, a, b, doc in zip(hit[some].tolist(), left[some], right[some], np.searchsorted(ends, low + hit[some], "right").tolist(), strict=True):
                            found.update((low + w - o, i, doc) for o, i in zip(offsets[a:b].tolist(), items[a:b].tolist(), strict=True))
            yield from found


def _pieces(words: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchored pieces of the items one after the other, each with one word of padding, where they start, whose they are and their place in the item."""
    places = [anchors(len(w)) for w in words]
    rows = np.array([np.concatenate([w[at:at + size], w[:1]]) for w, own in zip(words, places, strict=True) for at in own], np.uint64)
    return rows.ravel(), np.arange(len(rows)) * (size + 1), np.repeat(np.arange(len(words)), [len(own) for own in places]), np.concatenate(places).astype(np.int64)


def index(ids: list[int], words: list[np.ndarray], walks: dict[int, int], samples: int = SAMPLES, edit_rate: float = EDIT_RATE, first_walk: int = 0) -> Index:
    """``walks`` holds the number of walks for each class of steps."""
    sizes = sorted({steps_of(len(w)) for w in words})
    tables = {}
    for size in sizes:
        own = np.array([i for i, w in enumerate(words) if steps_of(len(w)) == size])
        symbols, starts, item, offset = _pieces([words[i] for i in own], size)
        shift = np.uint64(64 - max(BITMAP_BITS, len(starts).bit_length() + 3))
        for walk in range(first_walk, walks[size]):
            for (k, _), h in hashes(symbols, starts, [size], walk, samples).items():
                order = np.argsort(h, kind="stable")
                bitmap = np.zeros(1 << (64 - int(shift)), bool)
                bitmap[(h >> shift).view(np.int64)] = True
                tables[walk, k, size] = (h[order], own[item[order]], offset[order], bitmap, shift)
    return Index(ids, words, [set(w.tolist()) for w in words], sizes, walks, samples, edit_rate, tables)


def edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """The item with so many words replaced, added or removed."""
    copy = item.tolist()
    for _ in range(edits):
        at, kind = int(rng.integers(len(copy))), int(rng.integers(3))
        copy[at:at + (kind != 1)] = [int(rng.integers(1 << 62))] if kind != 2 else []
    return np.array(copy, np.uint64)


def plan(words: list[np.ndarray], edit_rate: float = EDIT_RATE, recall: float = RECALL, samples: int = SAMPLES, trials: int = 200, trial_words: int = 200_000) -> dict[int, int]:
    """For each class of steps the walks that find an item with floor(edit_rate * words) random edits with probability ``recall``, measured on the items.

    Every factor of two of the lengths is measured on its own; a class takes the walks of its hardest one. Very long items have fewer trials, 40 at least.
    """
    rng = np.random.default_rng(11)
    by: dict[int, list[np.ndarray]] = {}
    for w in words:
        by.setdefault(size_class(len(w)), []).append(w)
    out: dict[int, int] = {}
    for length, own in by.items():
        size, n = steps_of(length), max(40, min(trials, trial_words // length))
        used = [own[i] for i in sorted({t * len(own) // n for t in range(n)})]
        owner = [t % len(used) for t in range(n)]
        most = np.array([int(edit_rate * len(used[i])) for i in owner])
        # a gap of random words after each copy: no walk runs from one into the next
        copies = [np.concatenate([edited(used[i], m, rng), rng.integers(1 << 62, size=size).astype(np.uint64)]) for i, m in zip(owner, most.tolist(), strict=True)]
        begins = np.cumsum([0, *map(len, copies)])
        symbols, hit, walk = np.concatenate([*copies, np.zeros(size + 1, np.uint64)]), np.zeros(n, bool), 0
        while hit.mean() < recall:
            if walk == WALKS_TRIED:
                raise ValueError(f"items of {length} words with {edit_rate} edits a word are not found in {walk} walks")
            step = index([], used, {size: walk + 1}, samples, edit_rate, walk)
            for start, item, t in step.candidates(symbols, begins[1:], walk):
                hit[t] |= owner[t] == item and abs(int(begins[t]) - start) <= most[t]
            walk += 1
        out[size] = max(out.get(size, 1), walk)
    return out


def best_stretch(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the stretch of ``text`` nearest to ``item``; None if it takes more than ``most`` edits.

    Rows of the edit table run over the item; the start of the text is free. Insertions are resolved by a running minimum.
    """
    n = len(text)
    steps = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), steps.copy()
    for symbol in item:
        over = cost[:-1] + (text != symbol)
        down = cost + 1
        now, origin = down.copy(), start.copy()
        better = over < now[1:]
        now[1:][better], origin[1:][better] = over[better], start[:-1][better]
        # cost of coming from the left: min over k of now[k] + (i - k)
        shifted = (now - steps) * (n + 2) + steps[::-1]
        low = np.minimum.accumulate(shifted)
        source = steps[-1] - low % (n + 2)
        cost, start = now[source] + (steps - source), origin[source]
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end) if cost[end] <= most else None


def matches(texts: list[str | None], idx: Index) -> list[list[dict]]:
    """Matches of every text, by place."""
    out: list[list[dict]] = [[] for _ in texts]
    if not idx.sizes or not texts:
        return out
    codes, ends, raw, first, last = symbols_of(texts)
    symbols = np.concatenate([codes, np.zeros(idx.sizes[-1] + 1, np.uint64)])
    starts = np.cumsum([0, *[len(r) + 1 for r in raw]])
    taken: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for window, item, doc in sorted(idx.candidates(symbols, ends)):
        own, known = idx.words[item], taken.setdefault((doc, item), [])
        if known and window < known[-1][2] - len(own) // 2:  # this place is found
            continue
        most = int(idx.edit_rate * len(own))
        low, high = (int(ends[doc - 1]) if doc else 0), int(ends[doc])
        if window >= low and window + len(own) <= high and (symbols[window:window + len(own)] == own).all():
            known.append((0, window, window + len(own)))
        else:
            a, b = max(low, window - most), min(high, window + len(own) + most)
            # a stretch within the limit holds all but ``most`` of the item's words
            shared = sum(map(idx.kinds[item].__contains__, symbols[a:b].tolist()))
            found = best_stretch(own, symbols[a:b], most) if shared >= len(own) - most else None
            if found:  # once more around its place: the window may have started too early or too late to hold all of it
                a = max(low, a + found[1] - most)
                found = best_stretch(own, symbols[a:min(high, a + len(own) + 3 * most)], most) or found
                place = (found[0], a + found[1], a + found[2])
                if not known or place[1] >= known[-1][2]:
                    known.append(place)
    for (doc, item), places in taken.items():
        for edits, a, b in places:
            at, to = int(first[a] - starts[doc]), int(last[b - 1] - starts[doc])
            begin = len(raw[doc][:at].decode("utf-8"))
            out[doc].append({"item_id": idx.ids[item], "start": begin, "end": begin + len(raw[doc][at:to].decode("utf-8")), "edits": edits})
    for found in out:
        found.sort(key=lambda m: (m["start"], m["item_id"]))
    return out


def indexes(items: DataFrame, edit_rate: float = EDIT_RATE, recall: float = RECALL, samples: int = SAMPLES, block: int = BLOCK_ITEMS) -> Iterator[Index]:
    """One index per block of items."""
    ids, words = [], []
    for row in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        own = symbols_of([row["text"]])[0]
        if len(own):
            ids.append(row["item_id"])
            words.append(own)
        if len(ids) == block:
            yield index(ids, words, plan(words, edit_rate, recall, samples), samples, edit_rate)
            ids, words = [], []
    if ids:
        yield index(ids, words, plan(words, edit_rate, recall, samples), samples, edit_rate)


def find(docs: DataFrame, items: DataFrame, keep_text: bool = True, **options) -> DataFrame:
    """``docs`` (without ``text`` unless ``keep_text``) with ``matches``; ``start`` and ``end`` are code points of the lower-cased text."""
    kept = [c for c in docs.columns if c != "matches"]
    df = docs.select(*kept).withColumn("matches", F.array().cast(MATCH))
    for idx in indexes(items, **options):
        df = _pass(df, idx)
    return df if keep_text else df.drop("text")


def _pass(df: DataFrame, idx: Index) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast((idx.ids, idx.words, idx.walks, idx.samples, idx.edit_rate))
    names, schema = df.columns, df.schema
    text, had = names.index("text"), names.index("matches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index(*sent.value)
        for part in sliced(batches):
            found = matches(part.column(text).to_pylist(), own)
            column = pa.array([a + b for a, b in zip(part.column(had).to_pylist(), found, strict=True)], part.column(had).type)
            yield pa.RecordBatch.from_arrays([column if i == had else c for i, c in enumerate(part.columns)], schema=part.schema)

    return df.mapInArrow(run, schema)


@checks.add("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = find(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"), keep_text=False)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
