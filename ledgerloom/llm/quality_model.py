"""Quality classifier: compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled texts, one from good ones and one from bad
ones. A text is compressed once with each; the good dictionary's size less the bad one's, over
the text's own bytes, says which kind of text it resembles, and a logistic fit on other labelled texts
(those that neither dictionary saw) makes a score between 0 and 1 of it.

A dictionary helps most at the start of a text: later the text predicts itself. So whole texts
are compressed in blocks of BLOCK bytes, each on its own against both dictionaries, and the
sizes are added up: every part of a text counts, at any length.

Fitting reads a bounded sample: at most MAX_PER_CLASS rows a label and MAX_CHARS characters.
Scoring reads each row by itself: no shuffle, memory for one batch.

Cases: a null or empty text has no difference (0) and gets the calibrated score for that;
repeated rows get equal scores; a null id is passed on and counts as the empty string for
held_out; an empty table gives an empty result; if labels have only one class the score is its
share, with none 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.labelled import held_out, logistic_1d, training_rows
from ledgerloom.llm.words import slices

MAX_PER_CLASS = 3_000
MAX_CHARS = 16_000_000
DICT_BYTES = 112_640
BLOCK = 2_048
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the raw text if there is too little to train on."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    if sum(map(len, blocks)) > 10 * DICT_BYTES:
        return zstd.train_dictionary(DICT_BYTES, blocks, level=LEVEL).as_bytes()
    return b"".join(blocks)[-DICT_BYTES:]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.sides = [
            zstd.ZstdCompressor(
                level=LEVEL,
                dict_data=zstd.ZstdCompressionDict(d),
                write_content_size=False,
                write_dict_id=False,
                write_checksum=False,
            )
            for d in (model.good, model.bad)
            if d
        ]

    def difference(self, text: str | None) -> float:
        """(bytes with the good dictionary - bytes with the bad one) / bytes."""
        raw = (text or "").encode("utf-8", "replace")
        if not raw or len(self.sides) < 2:
            return 0.0
        good, bad = (s.compress for s in self.sides)
        d = 0
        for i in range(0, len(raw), BLOCK):
            part = raw[i : i + BLOCK]
            d += len(good(part)) - len(bad(part))
        return d / len(raw)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.model.slope * x + self.model.intercept, -30, 30)))


def fit_texts(rows: list[tuple[int, str]]) -> Model:
    """rows: (label, text). Every third text of a class calibrates, the others build."""
    sides = {y: [t for z, t in rows if z == y and t] for y in (0, 1)}
    if not sides[0] or not sides[1]:
        n = len(sides[0]) + len(sides[1])
        share = (len(sides[1]) + 1) / (n + 2)
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    build = {y: [t for i, t in enumerate(ts) if i % 3] or ts for y, ts in sides.items()}
    good, bad = (_dictionary([t.encode("utf-8", "replace") for t in build[y]]) for y in (1, 0))
    raw = Scorer(Model(good, bad, 0.0, 0.0))
    xy = [(raw.difference(t), y) for y, ts in sides.items() for t in ts[::3]]
    slope, intercept = logistic_1d(*zip(*xy, strict=True))
    return Model(good, bad, slope, intercept)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    return fit_texts(training_rows(docs, labels, label, MAX_PER_CLASS, MAX_CHARS))


def score_quality(
    docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score, predicted, difference for every row of docs."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in slices(batches, "text"):
            x = np.array([scorer.difference(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(scorer.score(x)), pa.array(x)],
                ["doc_id", "held_out", "score", "difference"],
            )

    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")
    )
    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, difference double")
    return out.select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "difference"
    )
