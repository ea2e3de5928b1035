"""Near-duplicate vectors by NN-descent, and exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hamming
from .common import Tables, connected_components

#: Neighbours a vector begins with, least number of random projections, vectors compared in one block, rounds after which a recall under RECALL is an error.
NEIGHBOURS, PROJECTIONS, BLOCK, ROUNDS = 10, 12, 256, 24
#: Share of links at the threshold itself that no projection may have brought together; projections merged at once.
MISSED, STEP = 0.01, 8
#: Members of a neighbourhood that are compared at once; larger neighbourhoods are compared in tiles of this size.
TILE = 512
#: Vectors with links that the recall audit asks for, vectors it samples at first and at most, the mean recall a vector at
#: which refinement may end, and the mean growth of a vector's links in a round that counts as none.
AUDIT, SAMPLE, SAMPLE_MOST, RECALL, GROWTH = 100, 1024, 8192, 0.98, 0.001


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, h) of rows with an id and a vector of finite numbers that is not zero, equal rows once; h is a hash of v."""
    # floats are kept as they are (half the bytes of each shuffle); all that is computed is computed in doubles
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), _numbers(vectors, vec_col).alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite).where(F.exists("v", lambda x: x != 0))
    return rows.distinct().select("id", "v", F.xxhash64("v").alias("h"))


def _numbers(vectors: DataFrame, vec_col: str) -> F.Column:
    kind = vectors.select(vec_col).schema[0].dataType.elementType.simpleString()
    return F.transform(F.col(vec_col), lambda x: x.cast("float" if kind == "float" else "double"))


def _matrix(column):
    """Unit rows (double precision) of an Arrow list column."""
    import numpy as np

    m = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)
    m /= np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _lists(ids, sim, threshold: float):
    """Neighbour lists of the vectors of a block: all links (cosine at the threshold or above), and the NEIGHBOURS nearest others."""
    import numpy as np
    import pyarrow as pa

    sim = np.minimum(sim, sim.T)  # both ends of a pair see one number
    np.fill_diagonal(sim, -2)
    sim[ids[:, None] == ids[None, :]] = -2
    row, col = np.nonzero(sim >= threshold)
    links = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(ids) + 1)), pa.int32()), pa.array(ids[col], pa.int64()))
    rest = np.where(sim >= threshold, -2, sim)
    k = min(NEIGHBOURS, len(ids))
    top = np.argpartition(-rest, k - 1, axis=1)[:, :k]
    cos = np.take_along_axis(rest, top, 1)
    good = cos > -2
    cuts = pa.array(np.concatenate([[0], np.cumsum(good.sum(1))]), pa.int32())
    near = pa.ListArray.from_arrays(cuts, pa.array(ids[top][good], pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), links, near, pa.ListArray.from_arrays(cuts, pa.array(cos[good], pa.float64()))], ["id", "links", "near", "cos"])


_LISTS = "id long, links array<long>, near array<long>, cos array<double>"


def _merge(lists: DataFrame) -> DataFrame:
    """One neighbour list a vector: all its links, however many (a saturated list is enlarged), and the NEIGHBOURS nearest others."""
    pairs = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"), F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("cos", "near")))).alias("all"))
    others = F.filter("all", lambda p: ~F.array_contains("links", p["near"]))
    pairs = pairs.select("id", "links", F.slice(F.sort_array(others, asc=False), 1, NEIGHBOURS).alias("all"))
    return pairs.select("id", "links", F.col("all.near").alias("near"), F.col("all.cos").alias("cos"))


def projections(n: int, threshold: float) -> int:
    """How many random orders of n vectors bring a pair at the threshold into one block, but for a share of MISSED.

    Two vectors share a bit of a sign code with the chance 1 - angle / pi, and are in one block if the bits that tell blocks
    apart are equal. Blocks begin anywhere in runs of equal codes and codes are not evenly used, which counts as two bits more.
    """
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    if n <= BLOCK:
        return 1
    hit = same ** math.log2(4 * n / BLOCK)
    return max(PROJECTIONS, math.ceil(math.log(MISSED) / math.log1p(-hit))) if 0 < hit < 1 else PROJECTIONS


def _project(rows: DataFrame, n: int, table: int, threshold: float) -> DataFrame:
    """Neighbours within blocks of BLOCK vectors that lie together in the order of a random sign code."""
    dims_seed, bits = 1000 + table, max(24, n.bit_length())

    def code(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            m = _matrix(batch.column(1))
            p = m @ np.random.default_rng(dims_seed).normal(size=(m.shape[1], bits))
            signs = (p > 0) @ (1 << np.arange(bits - 1, -1, -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signs.astype(np.int64)), pa.array(p[:, -1])], ["id", "v", "code", "last"])

    def block(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            while size >= BLOCK:
                t = pa.Table.from_batches(held).combine_chunks()
                yield compare(t.slice(0, BLOCK))
                held, size = t.slice(BLOCK).to_batches(), size - BLOCK
        if size:
            yield compare(pa.Table.from_batches(held).combine_chunks())

    def compare(t):
        m, ids = _matrix(t.column(1).chunk(0)), t.column(0).to_numpy()
        return _lists(ids, m @ m.T, threshold)

    parts = max(1, min(n // (4 * BLOCK), 4096))
    coded = rows.mapInArrow(code, f"id long, v {rows.schema['v'].dataType.simpleString()}, code long, last double")
    return coded.repartitionByRange(parts, "code", "last", "id").sortWithinPartitions("code", "last", "id").mapInArrow(block, _LISTS)


def _join_neighbours(rows: DataFrame, lists: DataFrame, number: int, threshold: float) -> DataFrame:
    """Neighbours of neighbours: every vector meets the members of a few neighbourhoods it belongs to, in tiles.

    A vector whose whole list lies above the threshold (it is saturated) joins the neighbourhoods of those of its
    neighbours that come first in a random order of this round, which its own neighbours choose too, so that a dense
    region is compared in few neighbourhoods; other vectors join those of all their neighbours, however far these are.
    """
    priority = lambda c: F.xxhash64(c, F.lit(number))
    lists = lists.select("id", "links", "near").where("size(links) + size(near) > 0")
    full = F.size("links") >= NEIGHBOURS
    first = F.transform(F.slice(F.sort_array(F.transform(F.array_union("links", F.array("id")), lambda x: F.struct(priority(x).alias("p"), x.alias("x")))), 1, 2), lambda s: s["x"])
    every = F.concat("links", "near")
    pivots = lists.select("id", F.explode(F.when(full, first).otherwise(F.concat(every, F.array("id")))).alias("pivot"))
    reverse = lists.where(~full).select(F.explode(every).alias("id"), F.col("id").alias("pivot"))
    members = pivots.union(reverse).distinct()
    sizes = members.groupBy("pivot").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    members = members.join(sizes, "pivot").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(number + 77)), F.col("chunks")).cast("int"))
    # a tile is a pair of chunks (lo <= hi) of one neighbourhood; a member goes to the tiles of its chunk
    tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("chunk", o).alias("lo"), F.greatest("chunk", o).alias("hi")))
    tiled = members.select("id", "pivot", F.explode(tiles).alias("tile")).join(rows, "id")

    def compare(t):
        import pyarrow as pa

        m, ids = _matrix(t.column("v").combine_chunks()), t.column("id").to_numpy()
        return pa.Table.from_batches([_lists(ids, m @ m.T, threshold)])

    return tiled.groupBy("pivot", "tile").applyInArrow(compare, _LISTS)


def _truth(rows: DataFrame, n: int, threshold: float, tables: Tables) -> DataFrame:
    """(id, n) of sampled vectors that have links: how many, found by comparing them with all rows in blocks.

    The sample is drawn from all vectors alike, whatever has been found of them, and enlarged up to SAMPLE_MOST vectors (the
    bound of what the driver receives) as long as fewer than AUDIT of them have links.
    """
    import numpy as np

    asked = SAMPLE
    while True:
        chosen = rows.orderBy(F.xxhash64("id", F.lit(6)), "id").limit(asked).collect()
        if not chosen:
            return rows.select("id", F.lit(0).cast("long").alias("n")).limit(0)
        shared = rows.sparkSession.sparkContext.broadcast(([r.id for r in chosen], np.array([r.v for r in chosen])))

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            ids, q = np.array(shared.value[0]), shared.value[1]
            q = q / np.abs(q).max(1, keepdims=True)
            q = q / np.sqrt((q * q).sum(1, keepdims=True))
            count = np.zeros(len(ids), np.int64)
            for batch in batches:
                for lo in range(0, len(batch), 1024):
                    part = batch.slice(lo, 1024)
                    near = _matrix(part.column(1)) @ q.T >= threshold
                    near &= part.column(0).to_numpy()[:, None] != ids[None, :]
                    count += near.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[count > 0]), pa.array(count[count > 0])], ["id", "n"])

        true = tables.save(rows.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")), f"truth-{asked}")
        if len(chosen) < asked or asked >= SAMPLE_MOST or true.count() >= AUDIT:
            return true
        asked = min(4 * asked, SAMPLE_MOST)


def _audit(true: DataFrame, lists: DataFrame) -> float:
    """Mean share, over the audited vectors, of a vector's links that the lists hold: a large group weighs no more than its vectors."""
    have = true.join(lists.select("id", F.size("links").alias("have")), "id", "left")
    r = have.agg(F.avg(F.least(F.lit(1.0), F.coalesce("have", F.lit(0)) / F.col("n"))).alias("recall")).first()
    return 1.0 if r.recall is None else r.recall


def _growth(old: DataFrame, new: DataFrame) -> float:
    """Mean share, over the vectors with links, of a vector's links that are new."""
    both = new.where("size(links) > 0").select("id", F.size("links").alias("n")).join(old.select("id", F.size("links").alias("was")), "id", "left")
    return both.agg(F.avg(1 - F.coalesce("was", F.lit(0)) / F.col("n")).alias("g")).first().g or 0.0


def graph(rows: DataFrame, threshold: float, tables: Tables, report: dict | None = None) -> DataFrame:
    """Neighbour lists (id, links, near, cos) of distinct vectors (id, v); every list holds all links that were found.

    Rounds of refinement, with further projections wherever the audited recall is short, go on until the recall is RECALL or
    more and links have stopped growing. If ROUNDS rounds don't reach the recall, that is an error. ``report`` gets the
    audited recall, or None if none of the sampled vectors has a link.
    """
    n = rows.count()
    lists, count = None, projections(n, threshold)
    for lo in range(0, count, STEP):  # a few at a time, so that the vectors of few orders lie on disk at once
        for t in range(lo, min(lo + STEP, count)):
            one = _project(rows, n, t, threshold)
            lists = one if lists is None else lists.union(one)
        lists = tables.save(_merge(lists), "lists-0" if lo + STEP >= count else f"seed-{lo}")
        tables.drop(f"seed-{lo - STEP}")
        tables.release()
    true = _truth(rows, n, threshold, tables)
    recall = _audit(true, lists)
    for number in range(1, ROUNDS + 1):
        # links are never cut off, and a block gives each to both ends, so lists stay symmetric
        found = lists.union(_join_neighbours(rows, lists, number, threshold))
        if recall < RECALL:  # what no list leads to is found by other orders only
            for t in range(count, count + STEP):
                found = found.union(_project(rows, n, t, threshold))
            count += STEP
        last, lists = lists, tables.save(_merge(found), f"lists-{number}")
        growth, recall = _growth(last, lists), _audit(true, lists)
        tables.drop(f"lists-{number - 1}")
        tables.release()
        if recall >= RECALL and growth <= GROWTH:
            break
    if report is not None:
        audited = true.count()
        report.update(recall=recall if audited else None, audited=audited, rounds=number, projections=count)
    if recall < RECALL:
        raise RuntimeError(f"audited recall of links is {recall:.4f} after {number} rounds and {count} projections, under {RECALL}")
    return lists


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing; rows with a null id get a null
    component and are not kept. Links are the pairs found by NN-descent with a cosine of ``threshold`` or more, in double
    precision; equal vectors are one vector with a count there, and link with each other. Vectors of different lengths link with
    nothing of another length. Rows that share an id and the vector are one; rows that share an id and differ are different vectors,
    each with links of its own. Ties don't matter. ``report`` gets the least audited recall of all lengths, or None if none was measured.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "vectors")
    rows = tables.save(usable(vectors, id_col, vec_col), "vectors")
    groups = rows.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.min("h").alias("h"))
    # a vector goes by its least id, or by its hash if that is the least id of other vectors too
    crowded = groups.groupBy("first").agg(F.count("*").alias("several")).where("several > 1")
    groups = groups.join(crowded, "first", "left").withColumn("id", F.when(F.col("several") > 1, F.col("h")).otherwise(F.col("first"))).drop("several")
    groups = tables.save(groups, "groups")
    several = groups.where("copies > 1")
    copied = rows.join(several.select("v", F.col("id").alias("node")), "v").select("id", "h", "node")
    members = tables.save(groups.where("copies = 1").select(F.col("first").alias("id"), "h", F.col("id").alias("node")).union(copied), "members")
    tables.drop("vectors")
    lists, reports = spark.createDataFrame([], _LISTS), []
    for r in groups.select(F.size("v").alias("n")).distinct().orderBy("n").collect():  # commonly one length
        reports.append({})
        lists = lists.union(graph(groups.where(F.size("v") == r.n).select("id", "v"), threshold, Tables(spark, "vectors"), reports[-1]))
    if report is not None and reports:
        report.update(min([x for x in reports if x["recall"] is not None] or reports, key=lambda x: x["recall"] or 0))
    near = lists.where("size(links) > 0").select("id", "links")
    edges = near.select("id", F.explode("links").alias("b")).where("id > b").select(F.col("id").alias("a"), "b")
    comp = connected_components(edges, tables, "links")
    # a link counts once for every copy at its other end
    more = near.join(several.select("id", "copies"), "id").select(F.explode("links").alias("id"), (F.col("copies") - 1).alias("more")).groupBy("id").agg(F.sum("more").alias("more"))
    n = groups.select("id", "first", "copies").join(near.select("id", F.size("links").alias("n")), "id", "left").join(more, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    count = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0)) + F.col("copies") - 1
    known = tables.save(n.select(F.col("id").alias("node"), "first", count.cast("long").alias("n"), F.coalesce("component", "id").alias("root")), "known")
    known = known.join(known.groupBy("root").agg(F.min("first").alias("component")), "root").select("node", "n", "component")
    found = members.join(known, "node").select(F.col("id").alias("vec_id"), "h", "n", "component")
    ids = vectors.select(F.col(id_col).alias("vec_id"), F.xxhash64(_numbers(vectors, vec_col)).alias("h"))
    out = ids.join(found, ["vec_id", "h"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


# Exact top-k search -------------------------------------------------------------------------------------------------

#: Words of the codes of a part of the table, at most, and those that are worth a part; pairs up to which all are compared at once, and queries that tell how far to search.
PART, LEAST, FEW, ASKED = 1 << 20, 1 << 12, 1 << 33, 256
#: In pairs that could be compared instead: one row found, one round.
FOUND, ROUND = 3000, 1 << 34


def sign_code(column: str) -> F.Column:
    """Code of a vector: the number of its components, then words of 64 bits, one for each component, set where it is positive (the
    last word is filled with zeros); null for null and empty vectors."""
    v = F.transform(column, lambda x: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    of = lambda w: F.concat(F.slice(v, w * 64 + 1, 64), F.array_repeat(F.expr("0L"), F.greatest((w + 1) * 64 - F.size(v), F.lit(0))))
    word = lambda w: F.aggregate(of(w), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    words = F.transform(F.sequence(F.lit(0), F.ceil(F.size(column) / 64).cast("int") - 1), word)
    return F.when(F.size(column) > 0, F.concat(F.array(F.size(column).cast("long")), words))


def top_k(codes: DataFrame, queries: DataFrame, k: int, tables: Tables | None = None) -> DataFrame:
    """The k nearest codes of every query by Hamming distance, ties by id: query_id, id, distance, rank.

    ``codes`` (id, code) and ``queries`` (query_id, code), codes as ``sign_code`` makes them, ids whole numbers; codes of another number of
    components are not compared. A query doesn't find the row of its own id. Codes are dealt by their hash into parts of bounded size,
    and every query goes to every part, which finds all codes up to a distance (``hamming.Part``: a multi-index over segments of
    16 bits with radii that together cover that distance). The distance grows until the kth neighbour of a query is within it; where it begins
    is taken from a few queries that are compared with all codes, and results don't depend on it. Null codes are no rows and no queries,
    repeated rows count once, and an empty table gives no rows. Equal codes are one entry with the k + 1 smallest ids, which is all
    that a top-k list can need.
    """
    spark = codes.sparkSession
    tables = tables or Tables(spark, "topk")
    kinds = [codes.schema["id"].dataType, queries.schema["query_id"].dataType]
    # null codes go when tables are reread: a condition on a code, put before it is kept, has every code made twice
    rows = codes.where("id is not null").select(F.col("id").cast("long").alias("id"), "code").distinct()
    rows = rows.withColumn("r", F.row_number().over(_by("code", "id"))).where(F.col("r") <= k + 1)
    entries = tables.save(rows.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries").where("code is not null")
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), "code").distinct()
    open_ = tables.save(asked, "asked").where("code is not null")
    lengths = {r.n: (r.rows, r.words) for r in entries.groupBy(F.element_at("code", 1).alias("n")).agg(F.count("*").alias("rows"), F.sum(F.size("code") - 1).alias("words")).collect()}
    sizes = {r.n: r.queries for r in open_.groupBy(F.element_at("code", 1).alias("n")).agg(F.count("*").alias("queries")).collect()}
    words, cores = sum(w for _, w in lengths.values()), spark.sparkContext.defaultParallelism
    parts = cores * math.ceil(words / (PART * cores)) if words > PART * cores else max(1, min(cores, math.ceil(words / LEAST)))
    reaches = {}
    if sum(lengths[n][1] * sizes.get(n, 0) for n in lengths) > FEW:
        some = tables.save(open_.orderBy(F.xxhash64("query_id", "code"), "query_id").limit(ASKED), "some")
        of = _nearest(_search(entries, some.withColumn("reach", _whole()), k, parts), k).groupBy("query_id").agg(F.count("*").alias("found"), F.max("distance").alias("kth"))
        far = {}
        for r in some.join(of, "query_id", "left").select(F.element_at("code", 1).alias("n"), "found", "kth").collect():
            far.setdefault(r.n, []).append(r.kth if r.found == k else r.n)
        reaches = {n: _reaches(kths, n, lengths.get(n, (0, 0))[0], sizes[n], k, parts) for n, kths in far.items()}
        tables.drop("some")
    done, number = [], 0
    while True:
        to = [F.lit(x).cast("int") for n, r in reaches.items() for x in (n, r[min(number, len(r) - 1)])]  # by length
        reached = open_.withColumn("reach", F.coalesce(F.create_map(*to)[_whole()], _whole()) if to else _whole())
        best = tables.save(_nearest(_search(entries, reached, k, parts), k), f"best-{number}")
        number += 1
        if number >= max(map(len, reaches.values()), default=1):
            return _united([*done, best]).select(F.col("query_id").cast(kinds[1]).alias("query_id"), F.col("id").cast(kinds[0]).alias("id"), "distance", "rank")
        # a query is done if its kth row is within the distance to which all of its codes have been searched
        kth = best.where(F.col("rank") == k).select("query_id", "distance")
        covered = tables.save(reached.groupBy("query_id").agg(F.min("reach").alias("reach")).join(kth, "query_id").where("distance <= reach").select("query_id"), f"covered-{number}")
        done.append(best.join(covered, "query_id", "left_semi"))
        open_ = tables.save(open_.join(covered, "query_id", "left_anti"), f"open-{number}")
        if open_.isEmpty():
            return _united(done).select(F.col("query_id").cast(kinds[1]).alias("query_id"), F.col("id").cast(kinds[0]).alias("id"), "distance", "rank")


def _whole() -> F.Column:
    """The distance that all codes of a length are within."""
    return F.element_at("code", 1).cast("int")


def _search(entries: DataFrame, asked: DataFrame, k: int, parts: int) -> DataFrame:
    """(query_id, distance, id): of each part, the k nearest rows of a query (query_id, code, reach) among those within its reach."""
    part = F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int")
    rows = entries.select(part.alias("part"), F.lit(False).alias("asks"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("reach"), "code", "ids")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = asked.select(every.alias("part"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), "reach", "code", F.array().cast("array<long>").alias("ids"))
    dealt = rows.union(asked).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "asks")
    return dealt.mapInArrow(lambda batches: hamming.search(batches, k), "query_id long, distance int, id long")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(_by("query_id", "distance", "id"))).where(F.col("rank") <= k)


def _united(found: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, found)


def _reaches(kths: list[int], n: int, rows: int, queries: int, k: int, parts: int) -> list[int]:
    """Distances to search to, one after the other, that cost the least for queries whose kth rows are as far as those of ``kths``; the last is
    that of all rows. What is left when the farthest of ``kths`` has been searched counts as one more query."""
    values, segments, pairs = sorted(set(kths)), min(4 * math.ceil(n / 64), hamming.MOST), max(1, rows * queries)
    cost = [(1 / (len(kths) + 1) + ROUND / pairs, [n])]  # of what is left from a value on, and the distances
    for i in range(len(values) - 1, -1, -1):
        left = [t for t in kths if t >= values[i]]
        found = [sum(min(k * parts, k * 3 ** min(max(0, v - t), 9)) for t in left) * FOUND / max(1, rows) for v in values[i:]]
        groups = parts * segments * min(queries * len(left) / len(kths), 1 << hamming.BITS) * hamming.GROUP
        costs = [((len(left) * hamming.share(v, segments) + f) / len(kths) + (groups + ROUND) / pairs + rest[0], [v, *rest[1]]) for v, f, rest in zip(values[i:], found, cost)]
        cost.insert(0, min(costs))
    return [v for v in cost[0][1][:-1] if v < n] + [n]


def _by(group: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(*order)
