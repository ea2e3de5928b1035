"""What the trained classifiers share: bounded training samples, features of byte n-grams, logistic fitting, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """At most ``per_class`` labelled texts of each class, of at most ``max_chars`` characters, from outside the held-out fold.

    ``per_class`` and ``max_chars`` are the documented bounds of what the driver receives. The rows with the smallest hash of
    their id are taken, so the sample is the same in every run. Ids with contradicting labels are left out; null labels too.
    The labels choose at most 4 * ``per_class`` ids a class, and only those (a bounded table) are sent to the scan of the texts.
    """
    from .common import crc_fold

    rank = F.xxhash64("doc_id")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_fold("doc_id", modulus) != held_out))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("y2")).where("y = y2 and y in (0, 1)")
    chosen = known.where("y = 0").orderBy(rank, "doc_id").limit(4 * per_class).union(known.where("y = 1").orderBy(rank, "doc_id").limit(4 * per_class))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    found = texts.join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")
    rows = []
    for y in (0, 1):
        rows += [(r.text, r.y) for r in found.where(F.col("y") == y).orderBy(rank, "doc_id", "text").limit(per_class).collect()]
    return rows


def below(hash_column, k: int, n: int):
    """Condition that about 1.5 * k of n rows meet, by the rank of a signed 64-bit hash; all rows if there are few."""
    return F.lit(True) if n <= 2 * k else hash_column < F.lit(int(-(1 << 63) + (1 << 64) * (1.5 * k / n)))


def few_rows(rows: DataFrame, k: int) -> list:
    """The k rows of (key, ...) with the smallest hash of key, or nearly so: rows are counted first, so that whatever the
    number of tasks no more than 3 * k rows reach the driver."""
    h = F.xxhash64("key")
    found = rows.where(below(h, k, rows.count())).withColumn("_h", h).limit(3 * k).collect()
    return sorted(found, key=lambda r: (r["_h"], tuple(map(str, r))))[:k]


def byte_batches(batch, column: int, most: int = 4 << 20) -> Iterator[tuple]:
    """Slices (start, offsets, bytes) of a string column of an Arrow batch; each slice holds up to ``most`` bytes, or one text."""
    import numpy as np

    texts = batch.column(column)
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    wide = "large" in str(texts.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


def sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def mix(x):
    """Spread uint64 values; the constants are those of a common finaliser."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def accuracy(scored: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Accuracy, precision and recall of ``predicted`` on held-out labelled rows, one row."""
    y = labels.select("doc_id", F.col(label).alias("y")).where("y is not null")
    j = scored.where("held_out").join(y, "doc_id")
    hit = F.sum(F.expr("int(predicted = 1 and y = 1)"))
    return j.agg(F.count("*").alias("n"), F.avg(F.expr("int(predicted = y)")).alias("accuracy"), (hit / F.sum("predicted")).alias("precision"), (hit / F.sum("y")).alias("recall"))
