"""Toxicity score by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams (orders 3 to 5) of the lower-cased bytes of a whole text, present or not. Each is scaled by the
log ratio of its smoothed counts in toxic and other training texts, those of about equal rate are left out, and a logistic regression is fitted on the scaled features.
Null texts score as empty ones. Every text is scored whole, repeats included; ids are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import byte_batches, sigmoid, training_sample
from .common import crc_fold, text_of

ORDERS, BITS = (3, 4, 5), 18
#: Bounds of the training sample: texts a class, and characters a text.
PER_CLASS, MAX_CHARS = 1500, 20_000
ALPHA, ROUNDS, STEP, L2 = 0.5, 150, 0.05, 1e-4
#: Features whose log ratio or number of training texts is smaller are left out.
LEAST_RATIO, LEAST_COUNT = 2.0, 8
#: The weight of all toxic training texts together.
TOXIC_SHARE = 0.1
MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.3


def grams(offsets, data, wanted=None):
    """Per slice of texts: (text number, feature) of every n-gram inside one text, not yet distinct; only ``wanted`` features if given."""
    import numpy as np

    low = (data + ((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint32)
    n, down = len(low), np.uint32(32 - BITS)
    rows, feats = [], []
    code = low
    for size in range(2, max(ORDERS) + 1):
        if n < size:
            break
        # up to four bytes are held exactly, more are folded in
        code = (code[:-1] << np.uint32(8) if size <= 4 else code[:-1] * np.uint32(0x01000193)) ^ low[size - 1 :]
        if size not in ORDERS:
            continue
        f = ((code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(size)) * np.uint32(0x85EBCA77) >> down
        at = np.flatnonzero(wanted[f]) if wanted is not None else np.arange(len(f))
        owner = np.searchsorted(offsets, at, "right") - 1
        inside = at + size <= offsets[owner + 1]
        rows.append(owner[inside])
        feats.append(f[at[inside]].astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(feats)


def distinct(rows, feats):
    import numpy as np

    key = np.unique((rows << BITS) | feats)
    return key >> BITS, key & ((1 << BITS) - 1)


def fit(sample: list[tuple[str, int]]) -> tuple:
    """(weight of each feature, bias). A sample without both classes gives a constant score."""
    import numpy as np

    y = np.array([s[1] for s in sample], np.float64)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(1 << BITS, np.float32), float(4 * (2 * y.mean() - 1)) if len(y) else -4.0
    rows, cols = [], []
    for i, (text, _) in enumerate(sample):
        raw = np.frombuffer(text.encode(), np.uint8)
        r, f = distinct(*grams(np.array([0, len(raw)]), raw))
        rows.append(r + i)
        cols.append(f)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    pos = ALPHA + np.bincount(cols, y[rows], 1 << BITS)
    neg = ALPHA + np.bincount(cols, 1 - y[rows], 1 << BITS)
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    # features of about the same rate in both classes, or seen too seldom, carry no weight
    ratio[(np.abs(ratio) < LEAST_RATIO) | (pos + neg < LEAST_COUNT + 2 * ALPHA)] = 0
    some = ratio[cols] != 0
    rows, cols = rows[some], cols[some]
    x = ratio[cols]
    w, b = np.zeros(1 << BITS), np.log(TOXIC_SHARE / (1 - TOXIC_SHARE))
    share = np.where(y == 1, TOXIC_SHARE / y.sum(), (1 - TOXIC_SHARE) / (1 - y).sum())
    gw2, gb2 = np.zeros(1 << BITS), 0.0
    for _ in range(ROUNDS):
        err = (sigmoid(np.bincount(rows, x * w[cols], len(y)) + b) - y) * share
        g = np.bincount(cols, err[rows] * x, 1 << BITS) + L2 * w
        gw2 += g * g
        gb2 += err.sum() ** 2
        w -= STEP * g / (np.sqrt(gw2) + 1e-9)
        b -= STEP * err.sum() / (np.sqrt(gb2) + 1e-9)
    return (ratio * w).astype(np.float32), float(b)


def scores(offsets, data, weights, bias: float):
    """Score of each text of a slice."""
    import numpy as np

    rows, feats = distinct(*grams(offsets, data, weights != 0))
    return sigmoid(np.bincount(rows, weights[feats], len(offsets) - 1) + bias)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; the model is fitted on ``labels.toxic`` of training rows."""
    plain = text_of(docs, id_col, text_col)
    model, bias = fit(training_sample(plain, labels, "toxic", MODULUS, HELD_OUT, PER_CLASS, MAX_CHARS))
    shared = docs.sparkSession.sparkContext.broadcast((model, bias))  # a fixed size, whatever the input

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model, bias = shared.value
        for batch in batches:
            got = [scores(offsets, data, model, bias) for _, offsets, data in byte_batches(batch, 1, 1 << 20)]
            if got:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got), pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = plain.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (crc_fold("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
