"""Best-fit packing of tokenised documents into fixed-length sequences by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens (only longer ones are cut, the first piece takes what is left
over). Pieces that fill a sequence alone are done. The others are dealt at random into blocks of about ``BLOCK`` pieces,
and each block is packed on several islands. A genome is a grouping (bin of each piece). Crossover injects whole
well-filled bins of one parent into the other, removes the bins that hold the same pieces, and puts the displaced ones back best-fit,
longest first; mutation dissolves the emptiest bins likewise. After each epoch the islands of a block exchange their
elites by a shuffle. What lies in loosely filled bins of all blocks is then packed again in fewer blocks.

Null ids are kept, null texts count as empty (one end token), repeated rows are packed as rows of their own. Results
hold for every row: ``row`` is a number given once to each piece in a written table. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, text_of

BLOCK, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 8192, 2, 4, 2, 12
#: Bins emptier than this share of the capacity are packed again, so many times.
LOOSE, LEVELS = 0.99, 2


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if ``ids``, the token ids as little-endian uint32 bytes."""

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .tokenize import byte_level

        encode, end = byte_level(tokenizer).encode, np.array([end_id], "<u4")
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(keys), 256):
                row, piece, start, length, crc, raw = [], [], [], [], [], []
                for i, got in enumerate(encode(texts.slice(lo, 256).to_pylist()), lo):
                    got = np.concatenate([got, end]).tobytes()
                    n = len(got) // 4
                    first = n % capacity or capacity
                    for k, (a, b) in enumerate(zip([0, *range(first, n, capacity)], range(first, n + 1, capacity))):
                        part = got[4 * a : 4 * b]
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(part))
                        raw.append(part)
                cols = [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * ids, names + ["ids"] * ids)

    kind = docs.schema[id_col].dataType.simpleString()
    return text_of(docs, id_col, text_col).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def best_fit(lengths, order, capacity: int, bins, room) -> tuple:
    """Put the pieces in ``order`` into ``bins`` (in place; -1: none yet), each where the least room remains. room: of the bins so far."""
    at = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, r in enumerate(room):
        if r > 0:
            at[r].append(b)
            mask |= 1 << r
    room = list(room)
    for i, s in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = at[r].pop()
            if not at[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i] = b
        r -= s
        room[b] = r
        if r:
            at[r].append(b)
            mask |= 1 << r
    return bins, room


def refill(lengths, bins, gone, capacity: int):
    """Dissolve the bins marked in ``gone`` and put their pieces back best-fit, longest first; bins are numbered anew."""
    import numpy as np

    number = np.cumsum(~gone) - 1
    fill = np.bincount(bins, lengths, len(gone)).astype(np.int64)
    loose = np.flatnonzero(gone[bins])
    new = number[bins].astype(np.int32)
    order = loose[np.argsort(-lengths[loose], kind="stable")]
    return best_fit(lengths, order, capacity, new, (capacity - fill[~gone]).tolist())[0]


def fitness(lengths, bins) -> tuple:
    import numpy as np

    fill = np.bincount(bins, lengths)
    return (-len(fill), float((fill * fill).sum()))


def crossover(a, b, lengths, capacity: int, rng):
    """Inject well-filled bins of ``a`` into ``b``; bins of ``b`` that share a piece with them go, their other pieces are refilled."""
    import numpy as np

    fill = np.bincount(a, lengths)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    inject = np.zeros(len(fill), bool)
    inject[rng.choice(good, max(1, len(good) // 6), replace=False)] = True
    taken = inject[a]
    n = int(b.max()) + 1
    gone = np.zeros(n, bool)
    gone[b[taken]] = True
    child = np.where(taken, n + a, b)
    # the injected bins keep their pieces, so only displaced ones lie in bins that are gone
    gone = np.concatenate([gone, np.zeros(len(fill), bool)])
    used = np.bincount(child, minlength=len(gone)) > 0
    return refill(lengths, child, gone | ~used, capacity)


def mutate(bins, lengths, capacity: int, rng):
    """Dissolve the emptiest bins and as many others."""
    import numpy as np

    fill = np.bincount(bins, lengths)
    k = max(1, len(fill) // 50)
    gone = np.zeros(len(fill), bool)
    gone[np.argsort(fill, kind="stable")[:k]] = True
    gone[rng.integers(0, len(fill), k)] = True
    return refill(lengths, bins, gone, capacity)


def evolve(lengths, population: list, capacity: int, generations: int, seed: int) -> list:
    """Groupings, the best first. An empty population starts from best-fit decreasing and from disturbed orders."""
    import numpy as np

    rng = np.random.default_rng(seed)
    none = lambda: np.full(len(lengths), -1, np.int32)
    while len(population) < POPULATION:
        noise = rng.normal(0, 0.02 * len(population) * capacity, len(lengths)) if population else 0
        population.append(best_fit(lengths, np.argsort(-(lengths + noise), kind="stable"), capacity, none(), [])[0])
    least = math.ceil(lengths.sum() / capacity)
    ranked = sorted(((fitness(lengths, p), i, p) for i, p in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    for g in range(generations):
        if -ranked[0][0][0] <= least:
            break
        i, j = rng.choice(len(ranked), 2, replace=False)
        child = crossover(ranked[min(i, j)][2], ranked[max(i, j)][2], lengths, capacity, rng)
        for c in (child, mutate(ranked[g % 2][2] if g % 3 else child, lengths, capacity, rng)):
            f = fitness(lengths, c)
            if all(f != r[0] for r in ranked):
                ranked = sorted([*ranked, (f, 0, c)], key=lambda x: x[0], reverse=True)[:POPULATION]
    return [p for _, _, p in ranked]


def _islands(spark: SparkSession, items: DataFrame, n: int, capacity: int, tables: Tables, name: str) -> DataFrame:
    """The best grouping of each block: rows (row, length, sequence_id, bin_fill)."""
    blocks = max(1, math.ceil(n / BLOCK))
    dealt = items.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    # a block is bounded by design: pieces are dealt by the hash of a unique number
    state = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("items"))
    state = state.select("block", F.col("items.row").alias("rows"), F.col("items.length").alias("lengths"), F.explode(F.array([F.lit(i) for i in range(ISLANDS)])).alias("island"))
    state = state.select("block", "island", "rows", "lengths", F.expr("cast(array() as array<binary>)").alias("population"))

    def epoch(k: int):
        def run(frames: Iterator) -> Iterator:
            import numpy as np

            for pdf in frames:
                out, score = [], []
                for r in pdf.itertuples():
                    lengths = np.asarray(r.lengths, np.int64)
                    given = [np.frombuffer(p, np.int32) for p in r.population]
                    best = evolve(lengths, given, capacity, GENERATIONS, 1_000_003 * k + 101 * int(r.block) + int(r.island))
                    out.append([p.astype(np.int32).tobytes() for p in best])
                    f = fitness(lengths, best[0])
                    score.append(f[0] * 1e15 + f[1])
                yield pdf.assign(population=out, score=score)

        return run

    schema = "block long, island int, rows array<long>, lengths array<long>, population array<binary>"
    for k in range(EPOCHS):
        if k:
            # the elite of the next island, around the ring, replaces this island's worst
            elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("population")[0].alias("elite"))
            state = state.join(elite, ["block", "island"]).select("block", "island", "rows", "lengths", F.concat(F.array("elite"), F.slice("population", 1, POPULATION - 1)).alias("population"))
        state = tables.save(state.repartition(blocks * ISLANDS, "block", "island").mapInPandas(epoch(k), schema + ", score double"), f"{name}-epoch{k}")
    best = state.groupBy("block").agg(F.max_by(F.struct("rows", "lengths", F.col("population")[0].alias("bins")), F.struct("score", "island")).alias("b")).select("b.*")

    def place(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in frames:
            for r in pdf.itertuples():
                rows, lengths, bins = np.asarray(r.rows, np.int64), np.asarray(r.lengths, np.int64), np.frombuffer(r.bins, np.int32)
                least = np.full(bins.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, bins, rows)
                yield pd.DataFrame({"row": rows, "length": lengths, "sequence_id": least[bins], "bin_fill": np.bincount(bins, lengths).astype(np.int64)[bins]})

    return tables.save(best.mapInPandas(place, "row long, length long, sequence_id long, bin_fill long"), f"{name}-placed")


def group(items: DataFrame, capacity: int, tables: Tables) -> DataFrame:
    """Group rows (row, length <= capacity) into sequences: rows (row, length, sequence_id)."""
    spark = items.sparkSession
    done = items.where(F.col("length") >= capacity).select("row", "length", F.col("row").alias("sequence_id"))
    items = items.where(F.col("length") < capacity)
    for level in range(LEVELS + 1):
        n = items.count()
        if not n:
            break
        placed = _islands(spark, items, n, capacity, tables, f"level{level}")
        if level == LEVELS or n <= BLOCK:
            done = done.unionByName(placed.drop("bin_fill"))
            break
        done = done.unionByName(placed.where(F.col("bin_fill") >= LOOSE * capacity).drop("bin_fill"))
        items = placed.where(F.col("bin_fill") < LOOSE * capacity).select("row", "length")
    return done


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    tables = Tables(docs.sparkSession, "packing")
    cut = tables.save(pieces(docs, tokenizer, capacity, end_id, ids, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    grouped = group(cut.select("row", "length"), capacity, tables)
    # a sequence holds at most `capacity` pieces
    members = grouped.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("m"))
    offsets = members.select("sequence_id", F.posexplode("m").alias("k", "x"), F.expr("transform(sequence(0, size(m) - 1), i -> aggregate(slice(m, 1, i), 0L, (a, y) -> a + y.length))").alias("before"))
    offsets = offsets.select("sequence_id", F.col("x.row").alias("row"), F.expr("before[k]").alias("offset"))
    return cut.join(offsets, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack(..., ids=True)``: sequence_id, n_tokens, ids (little-endian uint32 bytes)."""
    order = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), order.alias("m")).select("sequence_id", "n_tokens", F.expr("aggregate(m, cast('' as binary), (a, y) -> concat(a, y.ids))").alias("ids"))
