"""The bounded sample of labelled rows that the two classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 by 3: rows whose labels are never learned from."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    max_per_class: int,
    max_chars: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> list[tuple[int, str]]:
    """At most max_per_class (label, text) of each label, without held-out rows.

    Rows are taken in an order of hashed ids, so the sample is the same in every run; texts are
    whole, and rows are taken until max_chars is spent, half of it for each label. A text that alone is longer than that half is
    no training row (it is scored all the same). An id with two labels or texts is used with each, rows that repeat both once.
    """
    want = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    want = want.select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [want.where(F.col("y") == y).orderBy(*order).limit(max_per_class) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])  # at most 2 * max_per_class rows: small by its limit
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    got = texts.join(F.broadcast(ids), "doc_id").withColumn("n", F.length("text"))
    got = got.where(F.col("n") <= max_chars // 2).dropDuplicates(["doc_id", "y", "text"])
    # an even share of the characters for each class, in the same order
    from pyspark.sql import Window as W

    spent = F.sum("n").over(W.partitionBy("y").orderBy(*order, "text").rowsBetween(W.unboundedPreceding, 0))
    got = got.withColumn("spent", spent).where(F.col("spent") <= max_chars // 2)
    rows = got.select("doc_id", "y", "text").collect()
    return [(r.y, r.text) for r in sorted(rows, key=lambda r: (str(r.doc_id), r.y, r.text))]


def logistic_1d(x, y, steps: int = 200) -> tuple[float, float]:
    """(slope, intercept) of a logistic fit on one standardised input, by Newton with a small
    ridge; classes count alike, and targets keep away from 0 and 1 as in Platt's calibration."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    pos, neg = max(y.sum(), 1.0), max((1 - y).sum(), 1.0)
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    centre, scale = float(np.average(x, weights=weight)), float(x.std()) or 1.0
    z = np.stack([(x - centre) / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - target)) + 1e-4 * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)
