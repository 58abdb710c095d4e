"""Token-ID output: directly addressable codes.

A segment holds the token ids of consecutive documents. Ids are split into chunks of CHUNK_BITS
bits, lowest first. Level 0 has the lowest chunk of every id and a bitmap that tells which ids go
on; level 1 has the next chunk of those, and so on. A rank directory per level counts the set bits
before each block of RANK_BLOCK bits. So id i is read by one chunk a level: if its bit is set, it
goes on at place rank(i) of the next level. No block is decoded to reach a token.

Segment layout, little-endian: magic "DAC1", u8 chunk bits, u8 levels, u16 zero, u64 ids; then per
level: u64 entries, chunks (1 byte each), and but for the last level the bitmap, padded to 8
bytes, and its rank directory (u32 per block). The end-of-document id is part of the ids.

Segments are rows of a Parquet table in the shared folder (seg, first_doc.., n_tokens, payload), so
that Spark's committer makes the writing safe against lost executors and any store can hold it.
Documents are dealt to segments by ranges of doc_id and sorted inside; a segment's `start` in the
whole corpus is the sum of the sizes before it. `read_documents` reads it all back.

Cases: a null or empty text is the end id alone; a null doc_id sorts first; rows that repeat an
id are all written, in order of text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.exprs import let
from ledgerloom.llm.words import mix64, slices
from ledgerloom.session import work_path

CHUNK_BITS = 8
RANK_BLOCK = 512
END_ID = 2
#: Ids of a segment, about: it ends with the document that reaches it.
SEGMENT_IDS = 1_000_000
MAGIC = b"DAC1"


def encode(ids: np.ndarray) -> bytes:
    ids = np.asarray(ids, np.uint64)
    levels = max(1, -(-int(ids.max()).bit_length() // CHUNK_BITS)) if len(ids) else 1
    out = [MAGIC, struct.pack("<BBHQ", CHUNK_BITS, levels, 0, len(ids))]
    rest = ids
    for level in range(levels):
        out += [struct.pack("<Q", len(rest)), (rest & np.uint64(0xFF)).astype(np.uint8).tobytes()]
        rest = rest >> np.uint64(CHUNK_BITS)
        if level + 1 < levels:
            more = rest != 0
            bits = np.packbits(more, bitorder="little")
            bits = np.pad(bits, (0, -len(bits) % (RANK_BLOCK // 8)))
            per = np.unpackbits(bits.reshape(-1, RANK_BLOCK // 8), axis=1).sum(1, dtype=np.uint32)
            rank = np.concatenate(([0], np.cumsum(per, dtype=np.uint32)))[: len(per)].astype("<u4")
            out += [bits.tobytes(), rank.tobytes()]
            rest = rest[more]
    return b"".join(out)


class Reader:
    """Random access to the ids of a segment; chunks, bitmaps and ranks stay where they are."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment")
        bits, n_levels, _, self.n = struct.unpack_from("<BBHQ", data, 4)
        if bits != CHUNK_BITS:
            raise ValueError(f"chunks of {bits} bits")
        at, self.levels = 16, []
        for level in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bitmap = rank = None
            if level + 1 < n_levels:
                blocks = -(-n // RANK_BLOCK)
                bitmap = np.frombuffer(data, np.uint8, blocks * RANK_BLOCK // 8, at)
                at += len(bitmap)
                rank = np.frombuffer(data, "<u4", blocks, at)
                at += 4 * blocks
            self.levels.append((chunks, bitmap, rank))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, rank) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * level)
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BLOCK
            part = bitmap[block * RANK_BLOCK // 8 : (i >> 3) + 1].copy()
            part[-1] &= (1 << (i & 7)) - 1
            i = int(rank[block]) + int(np.unpackbits(part).sum())
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = np.zeros(self.n, np.uint64)
        where = np.arange(self.n)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            out[where] |= chunks.astype(np.uint64) << np.uint64(CHUNK_BITS * level)
            if bitmap is not None:
                where = where[np.unpackbits(bitmap, count=len(where), bitorder="little").astype(bool)]
        return out.astype(np.uint32)


class Encoder:
    """Texts to ids with a tokenizers file of byte-level BPE, as encode(text, add_special_tokens=False) of the
    library gives them: a special string in a text becomes its own id.

    Such a tokenizer never joins a token across a space that follows a character that is not white
    space, so texts are cut there, each distinct piece is encoded once and remembered, and a
    text's ids are put together from its pieces. The result is that of encoding the whole text; with a
    file of another kind texts are not cut.

    Pieces of up to LONG_PIECE bytes are found and looked up as arrays, by two independent 64-bit polynomials of their
    bytes whose bases and byte values each worker draws at random, so no text can be made to clash; longer pieces are encoded each
    time. Once more than CACHE_PIECES are remembered, all but the half as many that were
    used most are forgotten (about 60 bytes each). Texts are worked through in stretches of STRETCH bytes, so
    memory does not grow with the arrays of a long text, only with its bytes and ids.
    """

    CACHE_PIECES = 600_000
    JOINED = 1_000
    LONG_PIECE = 64
    STRETCH = 2_000_000
    _kept: dict[str, Encoder] = {}

    @classmethod
    def of(cls, conf: str, name: str) -> Encoder:
        """The encoder of a tokenizer's file contents that this worker keeps from task to task."""
        if name not in cls._kept:
            cls._kept.clear()
            cls._kept[name] = cls(conf)
        return cls._kept[name]

    def __init__(self, conf: str):
        # workers share the cores already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(conf)
        self.cut = _cuts_at_spaces(conf)
        self.special = [t["content"] for t in json.loads(conf).get("added_tokens", [])]
        self.line = self.encode(["\n"])[0][0]
        # of every known piece, in order of its hash: hash, second hash, place in the table, number of ids, uses
        self.hash, self.check, self.first = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.size, self.used = np.empty(0, np.int32), np.empty(0, np.int32)
        self.table, self.end = np.zeros(4096, np.uint32), 0
        draw = np.random.default_rng()
        self.byte = draw.integers(0, 1 << 64, 256, np.uint64)
        self.power, self.inverse = [], []
        for base in draw.integers(0, 1 << 62, 2).tolist():
            base = 2 * base + 1
            for into, x in ((self.power, base), (self.inverse, pow(base, -1, 1 << 64))):
                powers = np.full(self.STRETCH, x, np.uint64)
                powers[0] = 1
                into.append(np.cumprod(powers))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each).

        Pieces without white space but for a space at their start go to the library as lines, JOINED
        at a time, which spares it the setting up of a result for each: a line break before
        anything but white space is a token by itself, and none joins across it.
        """

        plain = np.array([w[0] != "\n" and not w[-1].isspace() and len(w.split()) == 1 and not w[:2].isspace() for w in pieces], bool)
        every = "\0".join(pieces)
        for x in self.special:
            if x in every:
                plain &= np.array([x not in w for w in pieces], bool)
        lined = [w for w, p in zip(pieces, plain.tolist(), strict=True) if p]
        lots = ["\n".join(lined[i : i + self.JOINED]) + "\n" for i in range(0, len(lined), self.JOINED)]
        ids = np.concatenate([np.array(g, np.uint32) for g in self.encode(lots)] or [np.empty(0, np.uint32)])
        ends = np.flatnonzero(ids == self.line)
        rest = self.encode([w for w, p in zip(pieces, plain.tolist(), strict=True) if not p])
        size, first = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        size[plain] = np.diff(ends, prepend=-1) - 1
        first[plain] = np.concatenate(([-1], ends))[: len(ends)] + 1
        size[~plain] = [len(g) for g in rest]
        first[~plain] = len(ids) + np.cumsum(size[~plain]) - size[~plain]
        ids = np.concatenate([ids, np.fromiter((i for g in rest for i in g), np.uint32)])
        return ids[_spread(first, size)], size

    def starts(self, raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where pieces begin: at texts, and at spaces that do not follow white space."""
        at = np.zeros(len(raw), bool)
        at[texts] = True
        for lo in range(0, len(raw), self.STRETCH):
            space = np.flatnonzero(raw[lo : lo + self.STRETCH] == 32) + lo
            space = space[space > 0]
            p1 = raw[space - 1]
            p2, p3 = raw[np.maximum(space - 2, 0)], raw[np.maximum(space - 3, 0)]
            white = (p1 <= 32) | ((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)))
            # U+1680, U+2000 to U+205F and U+3000: any of these blocks, so that no cut is ever wrong
            white |= ((p3 == 0xE1) & (p2 == 0x9A)) | ((p3 == 0xE2) & ((p2 == 0x80) | (p2 == 0x81))) | ((p3 == 0xE3) & (p2 == 0x80))
            at[space[~white]] = True
        return np.flatnonzero(at)

    def hashes(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(2, n): polynomials of the bytes of each piece, the same wherever it stands."""
        values, n = self.byte[raw], size.astype(np.uint64)
        sums = [np.add.reduceat(values * p[: len(raw)], starts) * i[starts] for p, i in zip(self.power, self.inverse, strict=True)]
        return np.stack([mix64(x + n) for x in sums])

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids, size = self.encode_pieces(pieces)
        end = self.end + len(ids)
        self.table = _room(self.table, end)
        self.table[self.end : end] = ids
        first = self.end + np.cumsum(size) - size
        self.end = end
        at = np.searchsorted(self.hash, hashes[0])
        self.hash, self.check = np.insert(self.hash, at, hashes[0]), np.insert(self.check, at, hashes[1])
        self.first = np.insert(self.first, at, first)
        self.size, self.used = np.insert(self.size, at, size), np.insert(self.used, at, 0)

    def forget(self) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.CACHE_PIECES // 2])
        take = self.table[_spread(self.first[keep], self.size[keep])]
        self.hash, self.check, self.size, self.used = self.hash[keep], self.check[keep], self.size[keep], self.used[keep] // 2
        self.first = np.cumsum(self.size, dtype=np.int64) - self.size
        self.table, self.end = take, len(take)

    def stretch(self, data: bytes, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces of data, number of ids of each)."""
        both = self.hashes(np.frombuffer(data, np.uint8), starts, size)
        if len(self.hash) > self.CACHE_PIECES:
            self.forget()

        def pieces(places: np.ndarray) -> list[str]:
            ends = (starts[places] + size[places]).tolist()
            return [data[a:z].decode() for a, z in zip(starts[places].tolist(), ends, strict=True)]

        h, where, which = np.unique(both[0], return_index=True, return_inverse=True)
        short = size[where] <= self.LONG_PIECE
        at = np.searchsorted(self.hash, h)
        new = np.ones(len(h), bool)
        new[at < len(self.hash)] = self.hash[at[at < len(self.hash)]] != h[at < len(self.hash)]
        new &= short
        if new.any():
            self.learn(both[:, where[new]], pieces(where[new]))
            at = np.searchsorted(self.hash, h)
        code = np.minimum(at, max(len(self.hash) - 1, 0))[which]
        by_self = size > self.LONG_PIECE
        if len(self.hash):
            by_self |= (self.hash[code] != both[0]) | (self.check[code] != both[1])
        n, first, table = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), self.table
        known = ~by_self
        self.used += np.bincount(code[known], minlength=len(self.hash)).astype(np.int32)
        n[known], first[known] = self.size[code[known]], self.first[code[known]]
        odd = np.flatnonzero(by_self)
        if len(odd):  # long pieces, and such as share a hash with another
            more = [np.array(g, np.uint32) for g in self.encode(pieces(odd))]
            n[odd] = [len(g) for g in more]
            first[odd] = len(table) + np.cumsum(n[odd]) - n[odd]
            table = np.concatenate([table, *more])
        return table[_spread(first, n)], n

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each)."""
        texts = [t or "" for t in texts]
        if not self.cut:
            got = [np.array(g, np.uint32) for g in self.encode(texts)]
            return (np.concatenate(got) if got else np.empty(0, np.uint32)), np.array([len(g) for g in got], np.int64)
        whole = [t.encode("utf-8", "replace") for t in texts]
        length = np.array([len(t) for t in whole], np.int64)
        data = b"".join(whole)
        del whole
        if not data:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        begin = np.cumsum(length) - length
        starts = self.starts(np.frombuffer(data, np.uint8), begin[length > 0])
        size = np.diff(starts, append=len(data))
        ends = starts + size
        ids, n, at = [], [], 0
        while at < len(starts):
            lo = starts[at]
            to = int(np.searchsorted(ends, lo + self.STRETCH, side="right"))
            if to == at:  # one piece of more than a stretch
                some = np.array(self.encode([data[lo : ends[at]].decode()])[0], np.uint32)
                ids.append(some)
                n.append([len(some)])
                at += 1
                continue
            some, count = self.stretch(data[lo : ends[to - 1]], starts[at:to] - lo, size[at:to])
            ids.append(some)
            n.append(count)
            at = to
        upto = np.concatenate(([0], np.cumsum(np.concatenate(n))))
        # pieces of a text: those that start in it
        edge = upto[np.searchsorted(starts, np.append(begin, len(data)))]
        return np.concatenate(ids), np.diff(edge)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a longer copy if it has not n places."""
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + n[0] - 1, first[1] .., one after the other."""
    n = n.astype(np.int64)
    upto = np.cumsum(n)
    return np.repeat(first - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)


def _cuts_at_spaces(file: str) -> bool:
    conf = json.loads(file)
    pre = conf.get("pre_tokenizer") or {}
    return (
        conf.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not any(" " in t["content"] for t in conf.get("added_tokens", []))
    )


def _below(cuts: list, value: Column) -> Column:
    """How many of the sorted cuts are at most value; in two steps, so that thousands of cuts cost
    a row only twice the square root of their number."""
    step = max(1, int(len(cuts) ** 0.5))

    def count(array: Column) -> Column:
        return F.aggregate(array, F.lit(0), lambda n, c: n + (value >= c).cast("int"))

    every = F.array(*[F.lit(c) for c in cuts])
    coarse = count(F.array(*[F.lit(c) for c in cuts[step - 1 :: step]]))
    return let(coarse, lambda k: k * step + count(F.slice(every, k * step + 1, F.lit(step))))


def deal_ranges(docs: DataFrame, tasks: int) -> DataFrame:
    """(doc_id, text, part), sorted inside each part: ranges of doc_id of about equal counts.

    The cuts are quantiles of the ids alone, so texts are read and moved once. Ids that are not
    numbers are dealt by Spark's own range sampling.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.NumericType):
        dealt = docs.repartitionByRange(tasks, "doc_id", "text").withColumn("part", F.spark_partition_id())
        return dealt.sortWithinPartitions("doc_id", "text")
    cuts: list = []
    if tasks > 1:
        at = [i / tasks for i in range(1, tasks)]
        cuts = sorted(set(docs.select(F.percentile_approx("doc_id", at, 10 * tasks).alias("q")).first()["q"] or []))
    part = F.lit(0)
    if cuts:
        part = F.when(F.col("doc_id").isNull(), 0).otherwise(_below(cuts, F.col("doc_id")))
    dealt = docs.withColumn("part", part.cast("int"))
    return dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("doc_id", "text")


SEGMENT_SCHEMA = "part int, seg int, doc_ids array<{0}>, sizes array<int>, n_tokens bigint, payload binary"


def write_documents(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tasks: int | None = None
) -> None:
    """Encode docs in ascending order of id into segments under path. The tokenizer's file is read by the driver alone."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    if tasks is None:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    with open(tokenizer, encoding="utf-8") as f:
        conf = f.read()
    sent, name = spark.sparkContext.broadcast(conf), hashlib.sha256(conf.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(sent.value, name)
        part, seg, ids, sizes, held, n = 0, 0, [], [], [], 0

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seg], pa.int32()),
                    pa.array([ids], pa.list_(arrow_id)),
                    pa.array([sizes], pa.list_(pa.int32())),
                    pa.array([n], pa.int64()),
                    pa.array([encode(np.concatenate(held))], pa.binary()),
                ],
                ["part", "seg", "doc_ids", "sizes", "n_tokens", "payload"],
            )

        for b in slices(batches, "text", 2_000_000):
            arrow_id = b.schema.field("doc_id").type
            part = b.column("part")[0].as_py()
            flat, count = encoder(b.column("text").to_pylist())
            stops = np.cumsum(count)
            flat = np.insert(flat, stops, END_ID)
            count = count + 1
            stops = np.concatenate(([0], np.cumsum(count)))
            doc_ids, at = b.column("doc_id").to_pylist(), 0
            while at < len(doc_ids):
                room = max(1, SEGMENT_IDS - n)
                to = min(len(doc_ids), max(at + 1, int(np.searchsorted(stops, stops[at] + room))))
                ids += doc_ids[at:to]
                sizes += count[at:to].tolist()
                held.append(flat[stops[at] : stops[to]])
                n += int(stops[to] - stops[at])
                at = to
                if n >= SEGMENT_IDS:
                    yield segment()
                    seg, ids, sizes, held, n = seg + 1, [], [], [], 0
        if ids:
            yield segment()

    dealt = deal_ranges(rows, tasks)
    dealt.mapInArrow(run, SEGMENT_SCHEMA.format(kind)).write.mode("overwrite").parquet(path)


def _starts(segs: DataFrame) -> DataFrame:
    """(part, seg, start): ids of the corpus before each segment. One row a segment (SEGMENT_IDS ids): parts are
    summed before they meet in one task."""
    parts = segs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = W.partitionBy("part").orderBy("seg")
    starts = segs.select("part", "seg", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("seg_start"))
    return starts.join(parts, "part").select("part", "seg", (F.col("part_start") + F.col("seg_start")).alias("start"))


def tokens_at(spark, path: str, positions: DataFrame, position_col: str = "position") -> DataFrame:
    """(position, id) of the ids at the given places of the corpus, each once, by random access: no segment is decoded.

    Places outside the corpus and nulls give no row. A place meets its segment by stretches of SEGMENT_IDS places.
    """
    segs = spark.read.parquet(path)
    spans = segs.select("part", "seg", "n_tokens").join(_starts(segs.select("part", "seg", "n_tokens")), ["part", "seg"])
    first, last = (F.floor(x / SEGMENT_IDS) for x in (F.col("start"), F.col("start") + F.col("n_tokens") - 1))
    spans = spans.withColumn("stretch", F.explode(F.sequence(first, last)))
    asked = positions.select(F.col(position_col).cast("bigint").alias("position")).where("position >= 0").distinct()
    asked = asked.withColumn("stretch", F.floor(F.col("position") / SEGMENT_IDS))
    inside = asked.join(spans, "stretch").where("position >= start and position < start + n_tokens")
    # at most as many as a segment has ids
    wanted = inside.groupBy("part", "seg").agg(F.min("start").alias("start"), F.collect_list("position").alias("positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                reader, start = Reader(b.column("payload")[k].as_py()), b.column("start")[k].as_py()
                places = b.column("positions")[k].as_py()
                ids = [reader[p - start] for p in places]
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(ids, pa.int64())], ["position", "id"])

    found = segs.select("part", "seg", "payload").join(wanted, ["part", "seg"])
    return found.select("payload", "start", "positions").mapInArrow(run, "position bigint, id bigint")


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the segments under path."""
    segs = spark.read.parquet(path)
    kind = segs.schema["doc_ids"].dataType.elementType.simpleString()
    starts = _starts(segs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = Reader(b.column("payload")[k].as_py()).all().astype("<u4")
                sizes = np.array(b.column("sizes")[k].as_py(), np.int64)
                stops = np.concatenate(([0], np.cumsum(sizes)))
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(stops[:-1], stops[1:], strict=True)]
                doc_ids = b.column("doc_ids")[k].values
                m = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids,
                        pa.array(np.full(m, b.column("part")[k].as_py()), pa.int32()),
                        pa.array(np.full(m, b.column("seg")[k].as_py()), pa.int32()),
                        pa.array(stops[:-1]),
                        pa.array(sizes),
                        pa.array(np.array(crc, np.int64)),
                    ],
                    ["doc_id", "part", "seg", "offset", "n_tokens", "ids_crc32"],
                )

    docs = segs.select("part", "seg", "doc_ids", "sizes", "payload").mapInArrow(
        run, f"doc_id {kind}, part int, seg int, offset bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return docs.join(starts, ["part", "seg"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs to a table of segments in the shared folder and read them back."""
    path = work_path(docs.sparkSession, "token-segments")
    write_documents(docs, path, tokenizer, id_col, text_col)
    return read_documents(docs.sparkSession, path)
