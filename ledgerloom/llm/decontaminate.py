"""Benchmark decontamination: SimHash of item-sized windows.

An item's fingerprint is the 64-bit SimHash of its five-word shingles, weighted by 1 over the
number of items that share a shingle. Windows of a text as long as an item are fingerprinted the same
way. A multi-index over the items' fingerprints, split into BLOCKS blocks, lists for every value of
a block the items within RADIUS // BLOCKS bits of it: by the pigeonhole principle every
fingerprint within RADIUS bits of an item's is found. Candidates are then verified exactly: weighted
shingle similarity (weights of common shingles over weights of all, with multiplicity) >= THRESHOLD.

Which windows are fingerprinted: all item-sized ones that contain a shingle of an item of that
size. A window without one has similarity 0 and cannot pass, so nothing is lost; nearly
all text is passed over by one bitmap lookup a word.

RADIUS 19 covers a similarity of 0.8: such features agree to a cosine of 0.89, a bit differs with
probability 0.15, and 64 bits differ in 9.7 +- 2.9 places.

A text is searched by itself: no shuffle, memory for one batch and the longest text. Items are
indexed in blocks of about BLOCK_ITEMS, which a worker builds once and keeps; PASS_BLOCKS of them are broadcast
together, and one pass over the corpus hashes each text once and probes them all; beyond, there is another pass. Weights
are those of the whole benchmark: shingles of two or more items are counted once and go to all blocks (16 bytes each), so
results do not depend on the blocks.

Cases: null or empty texts and items without a word match nothing; an item of fewer than five
words is one shingle of all its words; a text shorter than an item is one window; null ids are
passed on; repeated rows of documents each get their rows, repeated items are found each; empty
tables give an empty result; other columns are ignored. Ties go to the earliest window.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.llm.columns import unused
from ledgerloom.llm.words import WordHasher, mix64, shingles, slices

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 19
BLOCKS = 4
BLOCK_ITEMS = 2_000
PASS_BLOCKS = 10
FILTER_BITS = 22

_BITS = np.arange(64, dtype=np.uint64)


def signs(h: np.ndarray) -> np.ndarray:
    """(n, 64) of +1 and -1: the bits of each feature."""
    return (((mix64(h)[:, None] >> _BITS) & np.uint64(1)).astype(np.int8) * 2 - 1).astype(np.float64)


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits are set where a sum is positive."""
    return ((sums > 0).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class MultiIndex:
    """Items by the values of blocks of their fingerprints, neighbours included."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius, self.blocks = prints, radius, blocks
        self.width = 64 // blocks
        values = np.arange(1 << self.width, dtype=np.uint32)
        near = values[np.bitwise_count(values) <= radius // blocks]
        self.tables = []
        for b in range(blocks):
            v = self.block(prints, b)[:, None] ^ near[None, :]
            item = np.repeat(np.arange(len(prints)), len(near))
            order = np.argsort(v.ravel(), kind="stable")
            starts = np.searchsorted(v.ravel()[order], np.arange((1 << self.width) + 1))
            self.tables.append((starts, item[order].astype(np.int32)))

    def block(self, x: np.ndarray, b: int) -> np.ndarray:
        return ((x >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.uint32)

    def within(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in x, item) of all pairs within radius, each once."""
        pairs = []
        for b, (starts, items) in enumerate(self.tables):
            v = self.block(x, b)
            first, n = starts[v], starts[v + 1] - starts[v]
            place = np.repeat(np.arange(len(x)), n)
            at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            item = items[at]
            ok = hamming(x[place], self.prints[item]) <= self.radius
            pairs.append(place[ok] * len(self.prints) + item[ok])
        both = np.unique(np.concatenate(pairs))
        return both // len(self.prints), both % len(self.prints)


class Items:
    """A block of items, ready to be looked for.

    shared: the sorted shingles of two or more items of the benchmark, and how many items; without it, of this block.
    """

    def __init__(self, ids: list, texts: list[str | None], shared: tuple[np.ndarray, np.ndarray] | None = None):
        h, ends = WordHasher()(texts)
        self.ids, self.size, self.k, grams = [], [], [], []
        for i, item in enumerate(ids):
            w = h[ends[i] : ends[i + 1]]
            if len(w):
                self.ids.append(item)
                self.size.append(len(w))
                self.k.append(min(SHINGLE, len(w)))
                grams.append(shingles(w, self.k[-1]))
        self.size, self.k = np.array(self.size, np.int64), np.array(self.k, np.int64)
        own = Counter(int(g) for gs in grams for g in np.unique(gs))
        self.known = np.array(sorted(own), np.uint64)
        if shared is None:
            counts = np.array([own[int(g)] for g in self.known], np.int64)
            shared = self.known[counts > 1], counts[counts > 1]
        self.shared, self.shared_weight = shared[0], 1 / shared[1]
        self.bag = [Counter(g.tolist()) for g in grams]
        self.total = [self.weight_of(bag) for bag in self.bag]
        of: dict[int, list[int]] = {}
        for i, bag in enumerate(self.bag):
            for g in bag:
                of.setdefault(g, []).append(i)
        self.of = of
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.known >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        prints = [fingerprints((signs(g) * self.weights(g)[:, None]).sum(0)[None])[0] for g in grams]
        self.index = MultiIndex(np.array(prints, np.uint64)) if prints else None

    def places(self, g: np.ndarray) -> np.ndarray:
        """Where shingles of an item stand in g."""
        maybe = np.flatnonzero(self.filter[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.searchsorted(self.known, g[maybe])
        at[at == len(self.known)] = 0
        return maybe[self.known[at] == g[maybe]]

    def weights(self, g: np.ndarray) -> np.ndarray:
        """1 over the number of items that share a shingle; 1 for those of one item or of none."""
        if not len(self.shared):
            return np.ones(len(g))
        at = np.minimum(np.searchsorted(self.shared, g), len(self.shared) - 1)
        return np.where(self.shared[at] == g, self.shared_weight[at], 1.0)

    def weight_of(self, bag: dict[int, int]) -> float:
        n = np.fromiter(bag.values(), float, len(bag))
        return float((n * self.weights(np.fromiter(bag.keys(), np.uint64, len(bag)))).sum())

    def similarity(self, item: int, g: np.ndarray) -> float:
        bag, mine = self.bag[item], Counter(g.tolist())
        common = self.weight_of({x: min(n, bag[x]) for x, n in mine.items() if x in bag})
        return common / (self.total[item] + self.weight_of(mine) - common)

    def search(self, words: np.ndarray, hits: dict[int, np.ndarray]) -> list[tuple[int, int, int, float, int]]:
        """(item, start, words, similarity, bits apart) of the best window of each item found.

        hits: for each shingle length, where shingles of items stand in the text.
        """
        best: dict[int, tuple] = {}
        for k, at in hits.items():
            g = shingles(words, k)
            wanted: dict[int, list[int]] = {}
            for p in at.tolist():
                for n in {int(self.size[i]) for i in self.of[int(g[p])] if self.k[i] == k}:
                    wanted.setdefault(n, []).append(p)
            for n, ps in wanted.items():
                size = min(n, len(words))
                last, span = len(words) - size, size - k
                starts = np.unique(np.concatenate([np.arange(max(0, p - span), min(p, last) + 1) for p in ps]))
                # sums of signs up to each shingle, over the stretches the windows cover
                for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                    part = g[run[0] : run[-1] + span + 1]
                    upto = np.vstack([np.zeros((1, 64)), np.cumsum(signs(part) * self.weights(part)[:, None], 0)])
                    rel = run - run[0]
                    prints = fingerprints(np.round(upto[rel + span + 1] - upto[rel], 9))
                    place, item = self.index.within(prints)
                    fits = (self.size[item] == n) & (self.k[item] == k)
                    for w, i in zip(place[fits].tolist(), item[fits].tolist(), strict=True):
                        s = int(run[w])
                        sim = self.similarity(i, g[s : s + span + 1])
                        if sim >= THRESHOLD - 1e-12 and (i not in best or (-sim, s) < best[i][0]):
                            apart = int(hamming(prints[w : w + 1], self.index.prints[i : i + 1])[0])
                            best[i] = ((-sim, s), s, size, sim, apart)
        return [(i, *found[1:]) for i, found in sorted(best.items())]


_built: dict[str, list[Items]] = {}


def built(name: str, blocks: list[tuple[list, list[str | None]]], shared: tuple[np.ndarray, np.ndarray] | None) -> list[Items]:
    """The blocks of a broadcast, built once a worker; only those of the last one are kept."""
    if name not in _built:
        _built.clear()
        _built[name] = [x for x in (Items(ids, texts, shared) for ids, texts in blocks) if x.index is not None]
    return _built[name]


def search_texts(blocks: list[Items], hasher: WordHasher, texts: pa.Array | list[str | None]) -> list[tuple]:
    """(place of the text, block, item, start, words, similarity, bits apart)."""
    h, ends = hasher(texts)
    grams = {k: shingles(h, k) for k in {int(k) for items in blocks for k in items.k}}
    out = []
    for n, items in enumerate(blocks):
        found: dict[int, dict[int, np.ndarray]] = {}
        for k in np.unique(items.k).tolist():
            at = items.places(grams[k])
            text = np.searchsorted(ends, at, side="right") - 1
            inside = at + k <= ends[text + 1]
            at, text = at[inside], text[inside]
            cuts = np.flatnonzero(np.diff(text)) + 1
            for part, t in zip(np.split(at, cuts), np.split(text, cuts), strict=True):
                if len(t):
                    found.setdefault(int(t[0]), {})[k] = part - ends[t[0]]
        out += [(t, n, *row) for t in sorted(found) for row in items.search(h[ends[t] : ends[t + 1]], found[t])]
    return out


def shared_shingles(bench: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingles of two or more items of (item_id, text), and of how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher.of()
        for b in slices(batches, "text"):
            h, ends = hasher(b.column("text"))
            for at, to in zip(ends[:-1], ends[1:], strict=True):
                if to > at:
                    g = np.unique(shingles(h[at:to], min(SHINGLE, int(to - at))))
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], ["g"])

    counted = bench.select("text").mapInArrow(run, "g bigint").groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    got = counted.toArrow()
    g, n = got.column("g").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(g)
    return g[order], n[order]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity, hamming: one row for each text and item it holds."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind, item_kind = dict(rows.dtypes)["doc_id"], dict(bench.dtypes)["item_id"]
    schema = (
        f"doc_id {kind}, item_id {item_kind}, start_word bigint, n_words bigint, similarity double, hamming int"
    )
    item_type = to_arrow_type(bench.schema["item_id"].dataType)
    blocks = max(1, -(-bench.count() // block_items))
    shared = spark.sparkContext.broadcast(shared_shingles(bench) if blocks > 1 else None)
    out = None
    for k in range(0, blocks, PASS_BLOCKS):
        parts = []
        for i in range(k, min(blocks, k + PASS_BLOCKS)):
            part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
            got = part.collect()  # about block_items rows
            parts.append(([r.item_id for r in got], [r.text for r in got]))
        sent, name = spark.sparkContext.broadcast(parts), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            built_blocks, hasher = built(name, sent.value, shared.value), WordHasher.of()
            if not built_blocks:
                return
            for b in slices(batches, "text"):
                hits = search_texts(built_blocks, hasher, b.column("text"))
                if hits:
                    place, block, item, start, n, sim, apart = zip(*hits, strict=True)
                    ids = [built_blocks[x].ids[i] for x, i in zip(block, item, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column("doc_id").take(pa.array(place)),
                            pa.array(ids, item_type),
                            pa.array(start, pa.int64()),
                            pa.array(n, pa.int64()),
                            pa.array(sim, pa.float64()),
                            pa.array(apart, pa.int32()),
                        ],
                        ["doc_id", "item_id", "start_word", "n_words", "similarity", "hamming"],
                    )

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds an item.

    Rows are told apart by id and text together, so that a clean row never goes because another
    row has its id.
    """
    mark = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    key = F.struct(F.col(f"`{id_col}`").alias("id"), mark.alias("mark"))
    keyed = docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text"))
    found = find_contamination(keyed, benchmark, "key", "text").select("doc_id").distinct()
    bad_id, bad_mark = unused(docs, "bad_id", "bad_mark")
    bad = found.select(F.col("doc_id.id").alias(bad_id), F.col("doc_id.mark").alias(bad_mark))
    return docs.join(bad, (mark == F.col(bad_mark)) & F.col(f"`{id_col}`").eqNullSafe(F.col(bad_id)), "left_anti")
