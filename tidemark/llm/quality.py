"""Quality score by a byte-level convolutional network in numpy.

A whole text is cut into overlapping chunks of its UTF-8 bytes. Learned filters over WIDTH bytes slide over each chunk; their
largest activations in a chunk (max pooling), and over all chunks their largest, mean and smallest, go through a dense layer
to one probability. A filter's response to WIDTH bytes is the sum of one learned number a byte and place, so two bytes at a
time are looked up in a table. Null texts score as empty ones. Ids are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .classify import byte_batches, sigmoid, training_sample
from .common import crc_fold, text_of, with_row, with_text

WIDTH, FILTERS, CHUNK, STRIDE = 6, 16, 256, 192
#: Bytes whose responses are held at once; they take 64 times as much memory, twice over while they are summed.
BLOCK = 1 << 17
#: Bounds of the training sample: texts a class, and characters a text.
PER_CLASS, MAX_CHARS = 1200, 12_000
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: The weight of all good training texts together, so that texts too short to tell count as good.
GOOD_SHARE = 0.75
MODULUS, HELD_OUT, THRESHOLD = 3, 1, 0.5


def chunks(offsets):
    """Start and end of every chunk, and the text of each; every byte lies in a chunk, and every text has one at least."""
    import numpy as np

    length = np.diff(offsets)
    n = 1 + np.maximum(0, -(-(length - CHUNK) // STRIDE))
    owner = np.repeat(np.arange(len(length)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][owner] + k * STRIDE
    return start, np.minimum(start + CHUNK, offsets[1:][owner]), owner


def pooled(table, offsets, data, where: bool = False):
    """Largest response of each filter in each chunk, and the text of each chunk; with ``where`` also the place of each."""
    import numpy as np

    start, end, owner = chunks(offsets)
    out = np.zeros((len(start), FILTERS), np.float32)
    place = np.full((len(start), FILTERS), -1, np.int64)
    stop = end - WIDTH + 1
    some = np.flatnonzero(stop > start)
    for block in np.split(some, np.flatnonzero(np.diff(start[some] // BLOCK)) + 1) if len(some) else ():
        first = start[block[0]]
        wide = data[first : end[block].max()].astype(np.int32)
        m = len(wide) - WIDTH + 1
        pair = (wide[:-1] << 8) | wide[1:]
        r = table[0].take(pair[:m], axis=0)
        for j in range(1, WIDTH // 2):
            r += table[j].take(pair[2 * j : 2 * j + m], axis=0)
        if where:
            for c in block:
                part = r[start[c] - first : stop[c] - first]
                a = part.argmax(0)
                place[c], out[c] = start[c] + a, part[a, np.arange(FILTERS)]
        else:
            # chunks overlap, so even and odd ones are pooled in turn; reduceat takes [start, stop) pairs
            for c in (block[::2], block[1::2]):
                if len(c):
                    at = np.stack([start[c] - first, np.minimum(stop[c] - first, m - 1)], 1).ravel()
                    big = np.maximum.reduceat(r, at, axis=0)[::2]
                    out[c] = np.maximum(big, r[stop[c] - 1 - first])
    np.maximum(out, 0, out=out)
    return (out, owner, place) if where else (out, owner)


def summary(p, owner, n: int):
    """Largest, mean and smallest pooled response of each text, n x (3 * FILTERS)."""
    import numpy as np

    at = np.searchsorted(owner, np.arange(n))
    size = np.diff(np.append(at, len(owner)))[:, None]
    return np.concatenate([np.maximum.reduceat(p, at), np.add.reduceat(p, at) / size, np.minimum.reduceat(p, at)], 1)


def tables(kernel):
    """Lookup tables for pairs of bytes from the kernel (WIDTH x 256 x FILTERS)."""
    return [(kernel[2 * j][:, None, :] + kernel[2 * j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(WIDTH // 2)]


def fit(sample: list[tuple[str, int]]) -> dict:
    """Weights of the network, by Adam on a bounded sample. A sample without both gives a constant score."""
    import numpy as np

    y = np.array([s[1] for s in sample], np.float32)
    rng = np.random.default_rng(7)
    kernel = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
    w, b = rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32), np.zeros(1, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return {"kernel": kernel, "w": w * 0, "b": b + (4 if len(y) == 0 or y[0] else -4)}
    raw = [np.frombuffer(t.encode(), np.uint8) for t, _ in sample]
    weight = len(y) * np.where(y == 1, GOOD_SHARE / y.sum(), (1 - GOOD_SHARE) / (1 - y).sum())
    params = [kernel, w, b]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            offsets = np.cumsum([0, *[len(raw[i]) for i in rows]])
            data = np.concatenate([raw[i] for i in rows])
            p, owner, place = pooled_rows(kernel, offsets, data)
            x = summary(p, owner, len(rows))
            err = (sigmoid(x @ w + b) - y[rows]) * weight[rows] / len(rows)
            gx = err[:, None] * w[None, :]
            at = np.searchsorted(owner, np.arange(len(rows)))
            size = np.diff(np.append(at, len(owner)))
            gp = (gx[:, FILTERS : 2 * FILTERS] / size[:, None])[owner]
            for part, pick in ((0, x[:, :FILTERS]), (2, x[:, 2 * FILTERS :])):
                hit = p == pick[owner]
                share = np.add.reduceat(hit, at).astype(np.float32)
                gp += hit * (gx[:, part * FILTERS : (part + 1) * FILTERS] / np.maximum(share, 1))[owner]
            gp *= p > 0
            gk = np.zeros_like(kernel)
            c, f = np.nonzero(gp)
            spot = place[c, f]
            for j in range(WIDTH):
                np.add.at(gk[j], (data[spot + j], f), gp[c, f])
            step += 1
            for i, g in enumerate((gk, x.T @ err, np.array([err.sum()], np.float32))):
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.999 * m2[i] + 0.001 * g * g
                params[i] -= (RATE * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return {"kernel": kernel, "w": w, "b": b}


def pooled_rows(kernel, offsets, data):
    """``pooled`` for training: responses straight from the kernel, which changes with every step."""
    import numpy as np

    start, end, owner = chunks(offsets)
    m = len(data) - WIDTH + 1
    p = np.zeros((len(start), FILTERS), np.float32)
    place = np.zeros((len(start), FILTERS), np.int64)
    if m > 0:
        r = kernel[0][data[:m]]
        for j in range(1, WIDTH):
            r += kernel[j][data[j : j + m]]
        cols = np.arange(FILTERS)
        for c, (a, e) in enumerate(zip(start.tolist(), (end - WIDTH + 1).tolist())):
            if e > a:
                part = r[a:e]
                top = part.argmax(0)
                place[c], p[c] = a + top, part[top, cols]
    return np.maximum(p, 0), owner, place


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted (and ``row``, if ``carry``) for every row; the network is fitted on ``labels.quality`` of training rows."""
    plain = text_of(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(training_sample(plain, labels, "quality", MODULUS, HELD_OUT, PER_CLASS, MAX_CHARS)))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        net = shared.value
        lookup = tables(net["kernel"])
        for batch in batches:
            batch = with_text(batch, text_col) if carry else batch
            got = []
            for _, offsets, data in byte_batches(batch, 1, 1 << 20):
                p, owner = pooled(lookup, offsets, data)
                got.append(sigmoid(summary(p, owner, len(offsets) - 1) @ net["w"] + net["b"]).astype(np.float64))
            if got:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(i) for i in range(2, batch.num_columns)], pa.array(np.concatenate(got))], ["doc_id", *carried, "score"])

    carried = ["row"] * carry
    wide = with_row(docs, id_col, text_col).drop("text") if carry else plain
    kind = T.StructType([f for f in wide.schema.fields if f.name != "text"]).add("score", T.DoubleType())
    out = wide.mapInArrow(run, kind)
    return out.select("doc_id", *carried, (crc_fold("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
