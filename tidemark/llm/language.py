"""Language identification by nearest centroid over TF-IDF vectors of byte n-grams.

A whole text becomes a vector of hashed n-gram counts (orders 1 to 3 of its lower-cased UTF-8 bytes, all but letters taken as gaps), dampened, weighted by inverse
document frequency and scaled to length one. Each language has several centroids, clustered from training texts. The
language of the centroid with the largest cosine is predicted; a text farther from it than nearly all training texts of that
language is marked ``rejected``. Texts that are null or without letters get ``und``. Ids are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import byte_batches
from .common import crc_fold, text_of

BITS, CENTROIDS, ROUNDS = 12, 4, 8
#: Bounds of the training sample: texts a language (of whatever number of languages), characters in all and in a text; of a longer
#: text that is drawn, a stretch of MAX_CHARS is learnt from.
PER_LANGUAGE, ALL_CHARS, MAX_CHARS = 400, 40_000_000, 20_000
MODULUS, HELD_OUT = 4, 2
#: The share of training texts that lie nearer than the distance from which texts are rejected.
KEPT = 0.995


#: Lower-case letters and bytes of other alphabets stay as they are; all else is a gap (a space).
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counts(offsets, data):
    """Dampened n-gram counts of each text of a slice, as a dense matrix (texts x 2**BITS)."""
    import numpy as np

    d, n = 1 << BITS, len(offsets) - 1
    low = np.frombuffer(PLAIN, np.uint8)[data].astype(np.uint32)
    gap = low == 32
    one = (low * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    two = ((low[:-1] << np.uint32(8) | low[1:]) * np.uint32(0x85EBCA77) + np.uint32(0x1234567)) >> np.uint32(32 - BITS)
    three = ((low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]) * np.uint32(0xC2B2AE3D) + np.uint32(0x89ABCDE)) >> np.uint32(32 - BITS)
    # n-grams with two gaps in a row say nothing of the language; they go to the last column, which is left out
    void = gap[:-1] & gap[1:]
    one, two, three = np.where(gap, d, one), np.where(void, d, two), np.where(void[:-1] | void[1:], d, three)
    out = np.zeros((n, d), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for size, codes in ((1, one), (2, two), (3, three)):
            if b - a >= size:
                out[i] += np.bincount(codes[a : b - size + 1], minlength=d + 1)[:d]
    return np.log1p(out, out=out)


def unit(x):
    import numpy as np

    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def cluster(x, k: int):
    """Unit centroids by spherical k-means; starts from texts far from those chosen before."""
    import numpy as np

    chosen = [int(np.argmax(x @ x.mean(0)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    c = x[chosen]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        c = unit(np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c


def fit(sample: list[tuple[str, str]]) -> dict | None:
    import numpy as np

    if not sample:
        return None
    raw = [t.encode() for t, _ in sample]
    offsets = np.cumsum([0, *map(len, raw)])
    x = counts(offsets, np.frombuffer(b"".join(raw), np.uint8))
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
    x = unit(x * idf)
    names = sorted({lang for _, lang in sample})
    y = np.array([names.index(lang) for _, lang in sample])
    parts = [cluster(x[y == i], CENTROIDS) for i in range(len(names))]
    least = [float(np.quantile((x[y == i] @ p.T).max(1), 1 - KEPT)) for i, p in enumerate(parts)]
    return {"names": names, "idf": idf, "centroids": np.concatenate(parts), "of": np.repeat(np.arange(len(names)), [len(p) for p in parts]), "least": np.array(least)}


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """Texts of the training fold of every language: those with the smallest hash of their id, at most PER_LANGUAGE of each, and
    so many fewer (but not less than one) that ALL_CHARS characters suffice for all languages."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_fold("doc_id", MODULUS) != HELD_OUT) & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.least(F.length("text"), F.lit(MAX_CHARS))).alias("chars")).orderBy("lang").collect()
    h, out = F.xxhash64("doc_id"), []
    if not counts:
        return out
    each = max(1, min(PER_LANGUAGE, int(ALL_CHARS / sum(r.chars for r in counts))))
    # a share of each language by the rank of a hash, so that the driver gets a bounded number whatever the number of tasks
    share = docs.sparkSession.createDataFrame([(r.lang, int(-(1 << 63) + min((1 << 64) - 1, (1 << 64) * (1.5 * each / r.n))) if r.n > 2 * each else (1 << 63) - 1) for r in counts], "lang string, most long")
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - MAX_CHARS + 1)).cast("int") + 1
    found = rows.withColumn("lang", F.col("lang").cast("string")).join(F.broadcast(share), "lang").where(h <= F.col("most"))  # a row for each language
    found = found.select(h.alias("h"), "doc_id", F.substring("text", at, F.lit(MAX_CHARS)).alias("text"), "lang").limit(3 * each * len(counts)).collect()
    of: dict[str, list] = {}
    for x in found:
        of.setdefault(x.lang, []).append(x)
    for lang in sorted(of):
        mine = sorted(of[lang], key=lambda x: (x.h, x.doc_id is None, x.text))
        out += [(x.text, lang) for x in mine[:each]]
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine with the nearest centroid, 0 to 1) and rejected, for every row of ``docs``."""
    train = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(training_sample(train)))  # bounded by the sample's parameters

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            langs, cos, rejected = [], [], []
            for _, offsets, data in byte_batches(batch, 1, 1 << 20):
                # a matrix row for each text, so short texts are taken in smaller groups
                for lo in range(0, len(offsets) - 1, 512):
                    o = offsets[lo : lo + 513]
                    if m is None:
                        langs += ["und"] * (len(o) - 1)
                        cos.append(np.zeros(len(o) - 1))
                        rejected.append(np.ones(len(o) - 1, bool))
                        continue
                    c = unit(counts(o - o[0], data[o[0] : o[-1]]) * m["idf"]) @ m["centroids"].T
                    best = c.argmax(1)
                    of, top = m["of"][best], np.clip(c[np.arange(len(c)), best], 0, 1).astype(np.float64)
                    langs += [m["names"][i] for i in of]
                    cos.append(top)
                    rejected.append(top < m["least"][of])
            if langs:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(np.concatenate(cos)), pa.array(np.concatenate(rejected)), batch.column(2)], ["doc_id", "lang_pred", "score", "rejected", "letters"])

    kind = docs.schema[id_col].dataType.simpleString()
    plain = text_of(docs, id_col, text_col).withColumn("letters", F.col("text").rlike(r"\p{L}"))
    out = plain.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean, letters boolean")
    return out.select("doc_id", (crc_fold("doc_id", MODULUS) == HELD_OUT).alias("held_out"), F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"), (F.col("rejected") | ~F.col("letters")).alias("rejected"))
