"""MinHash near-dedup: Order MinHash and banded alignment.

Each distinct text gets SKETCHES sketches. A sketch hashes the text's five-word k-mers, each
labelled with its occurrence number, in an order of its own, takes the DEPTH smallest and puts them
back in text order: two texts share a sketch if the same k-mers stand in the same order, which
follows edit similarity, not just the sets. Texts that share a sketch are candidates, however many
they are. A short text (up to SHORT k-mers) is keyed by all its k-mers, so that it shares a key with
every text it has a k-mer in common with; texts a little longer have keys of both sorts.

Candidates are verified by a banded alignment of their words: similarity = 1 - edits / longer
length >= THRESHOLD (0.8). The band starts narrow and is widened until it is proven or has the
width of the allowed edits; the multiset of words gives a bound that spares most false ones.

With 64 sketches of depth 2, a pair of shingle similarity j is a candidate with probability
1 - (1 - j^2)^64: 0.92 at j = 0.2, to which 20 % of scattered word edits leave it, 1 - 1e-7 at j = 0.47 (10 %).

Work is linear in a group: exact copies are one text (by md5); a text is first compared with the hub it
shares most sketches with; what is so joined into one component need not be compared again; then come
the other candidates between components. Where more than SMALL texts share a key (a crowd), all pairs of texts of
different components are looked at: a matrix product of small word counts bounds the edits of a pair from below, and
what it leaves is verified, once however many crowds hold the pair. Only texts of like length (within a factor) meet there. That is
quadratic in a crowd, but only in bounds: 2,048 counters
a text, in lots of CROWD_LOT. No partner is dropped, no group is gathered in one task (members of
a hub travel in lots of LOT), and no links or components come to the driver.

Cases: null text counts as empty; texts without words are compared by exact copies only;
texts of fewer than five words have one k-mer of all their words; null ids are allowed, a class of them alone
has a null class_id; repeated rows are copies of each other; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.columns import unused
from ledgerloom.llm.words import WordHasher, mix64, shingles, slices
from ledgerloom.session import Scratch, written

KMER = 5
SKETCHES = 64
DEPTH = 2
#: K-mers up to which a text is keyed by each of them. A near copy of such a text has at most SHORTISH.
SHORT, SHORTISH = 20, 30
SMALL = 8
THRESHOLD = 0.8
LOT = 64
#: Texts of a lot of a crowd (2 KB of counters each), and texts whose pairs are bounded at once.
CROWD_LOT, CROWD_BLOCK = 8_192, 1_024
#: Shortest to longest text of a band.
BAND = 2.5
#: Counters of words and of pairs of words that bound the edits of a crowd's pairs, each counted up to LEVELS.
WORD_BINS, PAIR_BINS, LEVELS = 1_024, 1_024, 3
#: Rows of a lookup table (two or three numbers each) that may be broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 300_000

_ODD = (mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1))[:, None]
_EACH = np.arange(SKETCHES)


# sketches


def labelled_kmers(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mers of all texts one after the other, and their offsets."""
    n = np.diff(ends)
    per = np.where(n >= KMER, n - KMER + 1, (n > 0).astype(np.int64))
    stops = np.concatenate(([0], np.cumsum(per)))
    all_k = shingles(h, KMER)
    out = np.empty(stops[-1], np.uint64)
    for i in range(len(n)):
        if n[i] >= KMER:
            out[stops[i] : stops[i + 1]] = all_k[ends[i] : ends[i + 1] - KMER + 1]
        elif n[i]:
            out[stops[i]] = shingles(h[ends[i] : ends[i + 1]], int(n[i]))[0]
    # a later occurrence in the same text gets another value; few are
    text = np.repeat(np.arange(len(n)), per)
    own = out ^ mix64(text.astype(np.uint64) + np.uint64(1))
    ranked = np.sort(own)
    again = np.flatnonzero(np.isin(own, ranked[1:][ranked[1:] == ranked[:-1]]))
    if len(again):
        order = again[np.lexsort((again, own[again]))]
        first = np.concatenate(([True], own[order][1:] != own[order][:-1]))
        run = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        later = order[run > 0]
        out[later] = mix64(out[later] + run[run > 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out, stops


def sketch_keys(kmers: np.ndarray) -> np.ndarray:
    """The keys of one text's labelled k-mers."""
    n = len(kmers)
    short = mix64(np.unique(kmers) + np.uint64(1)) if n <= SHORTISH else kmers[:0]
    if n <= SHORT:
        return short
    place = np.empty((2, SKETCHES), np.int64)
    for at in range(0, SKETCHES, step := max(1, min(SKETCHES, 4_000_000 // n))):
        values = kmers[None, :] * _ODD[at : at + step]
        each = _EACH[: len(values)]
        place[0, at : at + step] = values.argmin(1)
        values[each, place[0, at : at + step]] = np.uint64(2**64 - 1)
        place[1, at : at + step] = values.argmin(1)
    a, b = kmers[place.min(0)], kmers[place.max(0)]  # the smallest two, in text order
    return np.concatenate([mix64(mix64(a ^ _ODD[:, 0]) + b), short])


# alignment


def word_bound(a: np.ndarray, b: np.ndarray) -> int:
    """No alignment of these words has fewer edits: the longer length less the common words."""
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    return max(len(a), len(b)) - int(np.minimum(ca[ia], cb[ib]).sum())


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Edit distances of all pairs at once, within `width` diagonals of the main one; a
    distance greater than width is only an upper bound."""
    p, far = len(pairs), np.int32(1 << 28)
    m = np.array([len(a) for a, _ in pairs])
    n = np.array([len(b) for _, b in pairs])
    rows, w = int(m.max()), width
    a = np.zeros((p, rows), np.uint64)
    b = np.full((p, int(max(n.max(), rows)) + 2 * w + 2), 1, np.uint64)  # hashes are never 0 or, padded, equal
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = x
        b[i, w + 1 : w + 1 + len(y)] = y
    k = np.arange(-w, w + 1, dtype=np.int32)
    d = np.broadcast_to(np.where(k >= 0, k, far), (p, 2 * w + 1)).astype(np.int32).copy()
    out = np.full(p, far, np.int32)
    end = n - m + w
    inside = (end >= 0) & (end <= 2 * w)
    ready = {int(r): np.flatnonzero((m == r) & inside) for r in np.unique(m)}
    if 0 in ready:
        out[ready[0]] = n[ready[0]]
    for i in range(1, rows + 1):
        # cell k of row i is column j = i + k; b[j] stands at w + j
        x = d + (b[:, i : i + 2 * w + 1] != a[:, i - 1 : i])
        np.minimum(x[:, :-1], d[:, 1:] + 1, out=x[:, :-1])
        x -= k
        np.minimum.accumulate(x, axis=1, out=x)
        x += k
        if i <= w:
            x[:, : w - i] = far  # columns before the first
        d = x
        if i in ready:
            r = ready[i]
            out[r] = d[r, end[r]]
    return out


def similarities(pairs: list[tuple[np.ndarray, np.ndarray]], threshold: float = THRESHOLD) -> np.ndarray:
    """1 - edits / longer length of each pair, -1 where it is under the threshold."""
    out = np.full(len(pairs), -1.0)
    open_: list[tuple[int, int]] = []
    for i, (a, b) in enumerate(pairs):
        longer = max(len(a), len(b))
        allowed = int((1 - threshold) * longer + 1e-9)
        if longer and abs(len(a) - len(b)) <= allowed and word_bound(a, b) <= allowed:
            open_.append((i, allowed))
    width = 12
    while open_:
        # pairs of like length together, about 4 million cells at a time
        open_.sort(key=lambda x: len(pairs[x[0]][0]))
        later, at = [], 0
        while at < len(open_):
            lot = max(1, min(len(open_) - at, 400_000 // ((2 * width + 1))))
            while lot > 1 and len(pairs[open_[at + lot - 1][0]][0]) > 1.3 * len(pairs[open_[at][0]][0]) + 16:
                lot = max(1, lot * 3 // 4)
            some = open_[at : at + lot]
            for (i, allowed), e in zip(some, banded([pairs[i] for i, _ in some], width).tolist(), strict=True):
                if e <= min(width, allowed):
                    out[i] = 1 - e / max(len(pairs[i][0]), len(pairs[i][1]))
                elif width < allowed:
                    later.append((i, allowed))
            at += lot
        if not later:
            break
        open_, width = later, min(width * 3, max(allowed for _, allowed in later))
    return out


# stages


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("h"), text.alias("text")
    )


def sketch_texts(texts: DataFrame) -> DataFrame:
    """(h, words, keys array<long>): one row a distinct text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher.of(), set()
        for b in slices(batches, "text"):
            hs = b.column("h").to_pylist()
            new = list({x: i for i, x in enumerate(hs) if x not in seen}.values())
            if len(seen) > 200_000:
                seen.clear()
            seen.update(hs)
            h, ends = hasher(b.column("text").take(pa.array(new, pa.int64())))
            kmers, stops = labelled_kmers(h, ends)
            out_h, words, keys = [], [], []
            for i, n, at, to in zip(new, np.diff(ends), stops[:-1], stops[1:], strict=True):
                if to > at:
                    out_h.append(hs[i])
                    words.append(n)
                    keys.append(sketch_keys(kmers[at:to]).view(np.int64))
            if out_h:
                offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                each = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_h, pa.binary()), pa.array(words, pa.int64()), each], ["h", "words", "keys"]
                )

    found = texts.select("h", "text").mapInArrow(run, "h binary, words bigint, keys array<bigint>")
    return found.dropDuplicates(["h"])


def _alike(a: str, b: str):
    """Texts of so many words may have THRESHOLD."""
    return F.least(a, b) >= F.greatest(a, b) - F.floor((1 - THRESHOLD) * F.greatest(a, b) + 1e-9)


def candidate_pairs(sketched: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b, n): the first pairs to compare with the number of keys that give them; and (key, t, words):
    the members of crowds. Texts are numbers t."""
    members = sketched.select("t", "words", F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("t").alias("hub")).where("n > 1")
    shared = keep.written(members.join(sizes, "key"), "near-shared")
    small = shared.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("t", "words"))).alias("ts"))
    each = small.select(F.posexplode("ts").alias("i", "b"), "ts").where("i > 0")
    each = each.select(F.explode(F.slice("ts", F.lit(1), F.col("i"))).alias("a"), "b")
    each = each.where(_alike("a.words", "b.words")).select(F.col("a.t").alias("a"), F.col("b.t").alias("b"))
    crowds = shared.where(F.col("n") > SMALL)
    star = crowds.where("t > hub").select(F.col("hub").alias("a"), F.col("t").alias("b"))
    counted = each.unionByName(star).groupBy("a", "b").agg(F.count("*").alias("n"))
    return keep.written(counted, "near-pairs"), crowds.select("key", "t", "words")


def bags(h: np.ndarray) -> tuple[bytes, list[int]]:
    """Counters of a text's words and pairs of words, up to LEVELS, and what is over that in each."""
    counts, over = [], []
    for x, bins in ((h, WORD_BINS), (shingles(h, 2), PAIR_BINS)):
        c = np.bincount((x >> np.uint64(32)).astype(np.int64) % bins, minlength=bins)
        low = np.minimum(c, LEVELS)
        counts.append(low.astype(np.uint8))
        over.append(int((c - low).sum()))
    return np.concatenate(counts).tobytes(), over


def _with_text(sides: DataFrame, n: int, texts: DataFrame, names: DataFrame) -> DataFrame:
    """sides (t, ..), n rows of them, with the text of t; of rows that have a text, one is read."""
    sides = sides.join(names.select("t", "h", "doc_id"), "t")
    one = texts.select(F.col("h").alias("_h"), F.col("doc_id").alias("_id"), "text")
    return one.join(_side(sides, n), (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_h", "_id", "h", "doc_id")


def text_bags(ts: DataFrame, texts: DataFrame, names: DataFrame) -> DataFrame:
    """(t, bag, over) of the texts t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher.of()
        for b in slices(batches, "text"):
            h, ends = hasher(b.column("text"))
            each = [bags(h[at:to]) for at, to in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("t"),
                    pa.array([x for x, _ in each], pa.binary()),
                    pa.array([x for _, x in each], pa.list_(pa.int64())),
                ],
                ["t", "bag", "over"],
            )

    found = _with_text(ts, ts.count(), texts, names).select("t", "text")
    return found.mapInArrow(run, "t bigint, bag binary, over array<bigint>").dropDuplicates(["t"])


def maybe_near(rows: list[dict], others: list[dict]) -> np.ndarray:
    """True where a pair may have THRESHOLD; False only where it cannot.

    A pair with e edits has at least longer - e words and longer - 1 - 2 e pairs of words in common.
    """
    n, m = (np.array([r["words"] for r in x]) for x in (rows, others))
    longer = np.maximum(n[:, None], m)
    allowed = ((1 - THRESHOLD) * longer + 1e-9).astype(np.int64)
    ok = longer - np.minimum(n[:, None], m) <= allowed
    if not ok.any():
        return ok
    a, b = (np.frombuffer(b"".join(r["bag"] for r in x), np.uint8).reshape(len(x), -1) for x in (rows, others))
    over = [np.array([r["over"] for r in x]) for x in (rows, others)]
    for k, (at, to, least) in enumerate(
        ((0, WORD_BINS, longer - allowed), (WORD_BINS, WORD_BINS + PAIR_BINS, longer - 1 - 2 * allowed))
    ):
        common = np.minimum(over[0][:, None, k], over[1][None, :, k]).astype(np.float32)
        for level in range(1, LEVELS + 1):
            common += (a[:, at:to] >= level).astype(np.float32) @ (b[:, at:to] >= level).astype(np.float32).T
        ok &= common >= least - 0.5
    return ok


def crowd_pairs(crowds: DataFrame, bag: DataFrame) -> DataFrame:
    """(a, b): all pairs of texts of a crowd (key, t, words, r) with different components r that may be near, a < b.

    A crowd is dealt by bands of length, BAND apart. Texts at the short end of a band may be near ones at the long end of the band
    before and are guests there; two guests meet in their own band. A band is dealt in lots of CROWD_LOT, of which every two
    meet. A pair is given by the least key of the crowds that hold both texts.
    """
    texts = crowds.groupBy("t", "r", "words").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # at most SKETCHES + SHORTISH a text
    each = texts.join(bag, "t").withColumn("key", F.explode("keys"))
    band = F.floor(F.log("words") / np.log(BAND)).cast("int")
    visits = F.when(F.col("words") < F.pow(F.lit(BAND), band) / (THRESHOLD - 0.01), F.array(band, band - 1)).otherwise(F.array(band))
    placed = each.select("*", F.posexplode(visits).alias("guest", "band"))
    bands = crowds.select("key", "words", F.explode(visits).alias("band"))
    lots = bands.groupBy("key", "band").agg(F.ceil(F.count("*") / CROWD_LOT).cast("int").alias("lots"))
    dealt = placed.join(lots, ["key", "band"])
    dealt = dealt.withColumn("lot", F.pmod(F.xxhash64("t"), F.col("lots")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    dealt = dealt.select(
        "key", "band", F.least("lot", "other").alias("i"), F.greatest("lot", "other").alias("j"), "lot", "guest", "t", "r", "words", "bag", "over", "keys"
    )
    parts = max(int(crowds.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    place = ["key", "band", "i", "j"]
    moved = dealt.repartition(parts, *place).sortWithinPartitions(*place)

    def found(group: list[dict]) -> Iterator[tuple[int, int]]:
        i, j, key = group[0]["i"], group[0]["j"], group[0]["key"]
        every, others = ([x for x in group if x["lot"] == k] for k in (i, j))
        for lo in range(0, len(every), CROWD_BLOCK):
            rows = every[lo : lo + CROWD_BLOCK]
            ra, ga = (np.array([x[c] for x in rows], np.int64) for c in ("r", "guest"))
            for at in range(lo if i == j else 0, len(others), CROWD_BLOCK):
                some = others[at : at + CROWD_BLOCK]
                rb, gb = (np.array([x[c] for x in some], np.int64) for c in ("r", "guest"))
                apart = (ra[:, None] != rb) & ((ga[:, None] & gb) == 0)
                if i == j:
                    apart &= lo + np.arange(len(rows))[:, None] < at + np.arange(len(some))
                if not apart.any():
                    continue
                last, mine = -1, set()
                for x, y in zip(*(x.tolist() for x in np.nonzero(apart & maybe_near(rows, some))), strict=True):
                    if x != last:
                        last, mine = x, set(rows[x]["keys"])
                    if next(k for k in some[y]["keys"] if k in mine) == key:
                        a, b = rows[x]["t"], some[y]["t"]
                        yield (a, b) if a < b else (b, a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in batches:
                yield from b.to_pylist()

        def batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

        out: list[tuple[int, int]] = []
        for _, group in groupby(rows(), key=lambda x: (x["key"], x["band"], x["i"], x["j"])):
            for pair in found(list(group)):
                out.append(pair)
                if len(out) == 50_000:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return moved.mapInArrow(run, "a bigint, b bigint")


def verify(pairs: DataFrame, texts: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, similarity) of written pairs at or over the threshold.

    names: (t, h, doc_id) of one row that has the text. Texts of members travel to their hub's lots; a
    hub's text is sent once a lot.
    """
    lots = pairs.groupBy("a").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    dealt = pairs.join(lots, "a").withColumn("lot", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int"))
    sides = dealt.select(F.col("b").alias("t"), F.col("a").alias("hub"), "lot").unionByName(
        lots.select(F.col("a").alias("t"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    )
    found = _with_text(sides, 2 * pairs.count(), texts, names).select("hub", "lot", "t", "text")
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    moved = found.repartition(parts, "hub", "lot").sortWithinPartitions("hub", "lot", (F.col("t") != F.col("hub")).cast("int"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, hub, hub_words, last = WordHasher.of(), None, None, None
        for b in slices(batches, "text", 8_000_000):
            ts, hubs = b.column("t").to_pylist(), b.column("hub").to_pylist()
            h, ends = hasher(b.column("text"))
            named, pairs = [], []
            for i, (x, y) in enumerate(zip(hubs, ts, strict=True)):
                if x == y:
                    if x != hub:
                        hub, hub_words = x, h[ends[i] : ends[i + 1]].copy()
                elif x == hub and (x, y) != last:  # rows that repeat id and text come again
                    named.append((x, y))
                    pairs.append((hub_words, h[ends[i] : ends[i + 1]]))
                last = x, y
            sims = similarities(pairs) if pairs else np.empty(0)
            ok = [i for i in range(len(pairs)) if sims[i] >= 0]
            if ok:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([named[i][0] for i in ok], pa.int64()),
                        pa.array([named[i][1] for i in ok], pa.int64()),
                        pa.array(sims[ok]),
                    ],
                    ["a", "b", "similarity"],
                )

    return moved.mapInArrow(run, "a bigint, b bigint, similarity double")


def _side(df: DataFrame, n: int) -> DataFrame:
    """A lookup table of n rows: broadcast while that is small, else left to a shuffle."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


class Roots:
    """(t, root) of texts that are not their component's smallest member; others are roots."""

    def __init__(self, table: DataFrame | None, keep: Scratch):
        self.table, self.keep = table, keep
        self.n = 0 if table is None else table.count()

    def of(self, df: DataFrame, *cols: str) -> DataFrame:
        """df with each column replaced by the root of what it holds."""
        if self.n:
            for c in cols:
                t = self.table.select(F.col("t").alias(c), F.col("root").alias("_root"))
                df = df.join(_side(t, self.n), c, "left").withColumn(c, F.coalesce("_root", c)).drop("_root")
        return df

    def merged(self, links: DataFrame) -> Roots:
        """The components after more links (a, b).

        Links are drawn between roots; each greater root hooks onto the least it is linked with,
        which gives trees; trees are flattened by doubling; links left between them go round again.
        """
        edges, table, keep = links.select("a", "b"), self.table, self.keep
        now = self
        while True:
            e = now.of(edges, "a", "b")
            e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
            edges = keep.written(e.distinct(), "near-edges")
            if edges.isEmpty():
                return now
            tree = _flat(edges.groupBy(F.col("b").alias("t")).agg(F.min("a").alias("root")), keep)
            if table is not None:
                moved = tree.of(table, "root").select("t", "root")
                table = keep.written(moved.unionByName(tree.table.select("t", "root")), "near-roots")
            else:
                table = tree.table
            now = Roots(table, keep)


def _flat(tree: DataFrame, keep: Scratch) -> Roots:
    """Every node of a forest of (t, root = parent, less than t) with its tree's root."""
    now = Roots(keep.written(tree, "near-tree"), keep)
    while True:
        up = now.table.select(F.col("t").alias("root"), F.col("root").alias("_up"))
        higher = now.table.select("t", "root").join(_side(up, now.n), "root", "left")
        higher = keep.written(
            higher.select("t", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "near-tree"
        )
        still = not higher.where("moved").isEmpty()
        now = Roots(higher.select("t", "root"), keep)
        if not still:
            return now


def _classes(docs: DataFrame, id_col: str, text_col: str, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h) of every row; (h, doc_id, n_rows, root) of every text: texts of one class have one root."""
    texts = _texts(docs, id_col, text_col)
    ids = written(texts.select("doc_id", "h"), "near-ids")
    first = keep.written(ids.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_rows")), "near-first")
    sketched = keep.written(sketch_texts(texts).withColumn("t", F.monotonically_increasing_id()), "near-sketches")
    # every text by a number; those without words are below zero, as no other is like them
    numbered = first.join(sketched.select("h", "t"), "h", "left")
    names = keep.written(numbered.withColumn("t", F.coalesce("t", -1 - F.monotonically_increasing_id())), "near-names")
    pairs, crowds = candidate_pairs(sketched, keep)

    # each text with the hub it shares most keys with
    best = keep.written(pairs.groupBy("b").agg(F.max(F.struct("n", "a")).alias("most")).select("most.a", "b"), "near-best")
    roots = Roots(None, keep).merged(keep.written(verify(best, texts, names), "near-links"))
    rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")

    def linked(more: DataFrame) -> Roots:
        """roots after those of the pairs that still lie between components."""
        ends = roots.of(more.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb")), "ra", "rb")
        apart = keep.written(ends.where("ra <> rb").select("a", "b"), "near-rest")
        return roots if apart.isEmpty() else roots.merged(keep.written(verify(apart, texts, names), "near-links"))

    roots = linked(rest)
    # all other pairs of crowds that span components
    here = keep.written(roots.of(crowds.withColumn("r", F.col("t")), "r"), "near-crowds")
    spans = here.groupBy("key").agg(F.min("r").alias("low"), F.max("r").alias("high")).where("low <> high")
    here = keep.written(here.join(spans.select("key"), "key"), "near-crowds")
    if not here.isEmpty():
        bag = keep.written(text_bags(keep.written(here.select("t").distinct(), "near-crowded"), texts, names), "near-bags")
        more = keep.written(crowd_pairs(here, bag), "near-crowd-pairs")
        roots = linked(more.join(pairs.select("a", "b"), ["a", "b"], "left_anti"))

    return ids, roots.of(names.select("h", "doc_id", "n_rows", F.col("t").alias("root")), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size, n_texts for every row of docs."""
    keep = Scratch(docs.sparkSession)
    ids, named = _classes(docs, id_col, text_col, keep)
    named = keep.written(named, "near-named")
    classes = named.groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.sum("n_rows").alias("class_size"), F.count("*").alias("n_texts")
    )
    # written, so that the join moves rows anew and a class of many texts can be split
    classes = keep.written(classes, "near-classes")
    of = written(named.select("h", "root").join(classes, "root").drop("root"), "near-class-of")
    keep.clear()
    return ids.join(of, "h").select("doc_id", "class_id", "class_size", "n_texts")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: that of its least doc_id, then text hash (of rows that repeat both, one).

    Rows are told apart by id and text together: null or repeated ids never take another class's row away.
    """
    keep = Scratch(docs.sparkSession)
    ids, named = _classes(docs, id_col, text_col, keep)
    near_id, near_h, near_n = unused(docs, "near_id", "near_h", "near_n")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least")
    best = named.groupBy("root").agg(least).select(F.col("least.doc_id").alias(near_id), F.col("least.h").alias(near_h))
    same = (ids["h"] == F.col(near_h)) & ids["doc_id"].eqNullSafe(F.col(near_id))
    kept = written(ids.join(best, same).groupBy(near_id, near_h).agg(F.count("*").alias(near_n)), "near-kept")
    keep.clear()
    mark = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))
    out = docs.join(kept, (mark == F.col(near_h)) & F.col(f"`{id_col}`").eqNullSafe(F.col(near_id)))
    columns = [F.col(f"`{x}`") for x in docs.columns]
    once = out.where(F.col(near_n) == 1).select(*columns)
    if kept.where(F.col(near_n) > 1).isEmpty():
        return once
    again = out.where(F.col(near_n) > 1).dropDuplicates([near_id, near_h]).select(*columns)
    return once.unionByName(again)
