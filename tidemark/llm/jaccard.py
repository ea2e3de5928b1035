"""Exact n-gram Jaccard join by a grouped prefix join, and the components of its links.

A document is the set of its distinct word shingles, as 64-bit hashes. Documents with equal sets are one class. In one global order
of shingles, two sets can only reach the threshold if their prefixes share a shingle. Classes with the same prefix and the
same size form a group, groups meet on the shingles of their prefixes, group pairs are filtered by size and by where the first shingle
that they share stands, and the pairs that are left are expanded to their member classes and verified.

The order is that of the number of documents that hold a shingle, rarest first, so common lines and passages stand outside most
prefixes. The counts are exact: shingles are counted in buckets of their hash, where a slice of documents sends each of its shingles
once, and what occurs twice or more goes back to its slice. Shingles of one document can link nothing, so only the others are kept;
they also suffice to verify a pair, together with the sizes of the sets.

Only components are asked for, so classes that are already connected are not compared again: first every group is verified
against a few groups that share most with it, in passes that end once the lists still open are short,
and only then are all remaining pairs between different components compared. No link between components is lost.

Nulls: a null text is an empty one; empty sets link with nothing; a row without id takes part in nothing and gets a null component. Repeated
rows are equal sets. Other columns are ignored. Very long texts are taken whole. The documents must come from a plan that gives the same
rows in the same order when a lost part is computed again, such as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import byte_batches, mix
from .common import Tables, connected_components, text_of

WORDS = 5
#: Shingles in fewer documents than this are not told apart by their number (those of one document come first).
OVERALL = 2
#: Most passes before all pairs are looked at, groups under one head, and heads that a group is compared with in a pass.
PASSES, PART, PARTNERS = 2, 16, 4
#: Bytes of text whose shingles are sent together, those of them that are hashed at a time (in arrays of some fifty times the
#: size), and about so many bytes of text a bucket of shingles.
SLICE, HASHED, BUCKET = 2 << 20, 1 << 18, 4 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = [(0xBF58476D1CE4E5B9 * (2 * j + 3) + 2 * j) % (1 << 64) | 1 for j in range(WORDS)]


def shingle_sets(offsets, data, words: int = WORDS):
    """For each text of a slice the sorted distinct hashes of its shingles."""
    import numpy as np

    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * n
    low = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = word & (np.concatenate([[True], ~word[:-1]]) | first[:-1])
    ends = word & (np.concatenate([~word[1:], [True]]) | first[1:])
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # a word's hash is a sum over its bytes of table[byte] * base^place, from running sums; all arithmetic is modulo 2^64
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _BASE, np.uint64)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(table[low] * power[:-1])])
    shift = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _INVERSE, np.uint64)]))
    h = mix((total[stop] - total[start]) * shift[start])
    at = np.searchsorted(start, offsets)
    count = np.diff(at)
    place = np.array(_PLACE if words == WORDS else [(0xBF58476D1CE4E5B9 * (2 * j + 3)) % (1 << 64) | 1 for j in range(words)], np.uint64)
    if len(h) >= words:
        s = h[: len(h) - words + 1] * place[0]
        for j in range(1, words):
            s = s + h[j : len(h) - words + 1 + j] * place[j]
        s = mix(s)
    out = []
    for i in range(n):
        a, c = at[i], count[i]
        if c >= words:
            out.append(np.unique(s[a : a + c - words + 1]))
        elif c:
            out.append(mix((h[a : a + c] * place[:c]).sum(keepdims=True) + np.uint64(int(c) * 0x632BE59BD9B4E019 % (1 << 64))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def hashed_sets(offsets, data):
    """``shingle_sets`` of a slice, of up to ``HASHED`` bytes or one text at a time."""
    import numpy as np

    sets, k = [], 0
    while k < len(offsets) - 1:
        upto = max(k + 1, int(np.searchsorted(offsets, offsets[k] + HASHED, "right")) - 1)
        sets += shingle_sets(offsets[k : upto + 1] - offsets[k], data[offsets[k] : offsets[upto]])
        k = upto
    return sets


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


_TRAVEL = "slice long, bucket long, docs int, tokens binary, refs binary, counts binary, ids array<long>, sizes array<int>, nodes array<long>"


def _rows(rows: list[dict]):
    import pyarrow as pa

    kinds = {"slice": pa.int64(), "bucket": pa.int64(), "docs": pa.int32(), "tokens": pa.binary(), "refs": pa.binary(), "counts": pa.binary(), "ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "nodes": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in kinds.items()], list(kinds))


def dealt_shingles(plain: DataFrame, bits: int) -> DataFrame:
    """The distinct shingles of every slice of documents, in 2^bits buckets, and one head row a slice that describes its documents.

    ``refs`` tells which document of the slice holds a shingle; if several do, it is ``docs`` plus the number of a list in the
    head, so that a shingle which stands everywhere is sent once a slice, with the length of its list in ``counts``.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        from pyspark import TaskContext

        np.seterr(over="ignore")
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, o, d in byte_batches(batch, 1, SLICE):
                sets = hashed_sets(o, d)
                size = np.array([len(x) for x in sets], np.int64)
                flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), size)
                spread = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat * np.uint64(0x9FB21C651E98DF25)))])
                at = np.concatenate([[0], np.cumsum(size)])
                node = spread[at[1:]] - spread[at[:-1]] + size.astype(np.uint64)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, int)
                count = np.diff(np.append(first, len(flat)))
                token, ref, many = flat[first], owner[first], count > 1
                ref[many] = len(sets) + np.arange(many.sum())
                ref = ref.astype(_width(len(sets) + int(many.sum())))
                members = owner[np.repeat(many, count)]
                rows = [{"slice": number, "bucket": number % (1 << bits), "docs": len(sets), "refs": members.tobytes(), "counts": count[many].astype(np.uint32).tobytes(), "ids": batch.column(0).slice(lo, len(sets)).to_pylist(), "sizes": size.tolist(), "nodes": node.view(np.int64).tolist()}]
                bucket = (token >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(token), np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(token) else np.zeros(0, int)
                for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(token)).tolist()):
                    rows.append({"slice": number, "bucket": int(bucket[a]), "docs": len(sets), "tokens": token[a:b].tobytes(), "refs": ref[a:b].tobytes(), "counts": count[a:b][many[a:b]].astype(np.uint32).tobytes()})
                yield _rows(rows)
                number += 1

    return plain.mapInArrow(run, _TRAVEL)


def _width(n: int):
    import numpy as np

    return np.uint16 if n <= 1 << 16 else np.uint32


def _refs(row: dict):
    import numpy as np

    return np.frombuffer(row["refs"], np.uint16 if len(row["refs"]) * 4 == len(row["tokens"]) else np.uint32)


def _by_key(batches: Iterator, column: int) -> Iterator[list[dict]]:
    """Runs of rows that agree in a column, from batches that are sorted by it."""
    held, key = [], None
    for batch in batches:
        for k in range(0, len(batch), 64):
            for r in batch.slice(k, 64).to_pylist():
                if held and r[batch.schema.names[column]] != key:
                    yield held
                    held = []
                key = r[batch.schema.names[column]]
                held.append(r)
    if held:
        yield held


def shared_shingles(dealt: DataFrame) -> DataFrame:
    """The rows of ``dealt`` with only those shingles that two documents or more hold; ``counts`` is the number of documents of
    each, one byte on a logarithmic scale (exact below 16), as it only decides the order."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for rows in _by_key(batches, 1):
            heads = [r for r in rows if r["tokens"] is None]
            for r in heads:
                yield _rows([r])
            rows = [r for r in rows if r["tokens"] is not None]
            if not rows:
                continue
            tokens = [np.frombuffer(r["tokens"], np.uint64) for r in rows]
            refs = [_refs(r) for r in rows]
            weight = np.ones(sum(map(len, refs)), np.int64)
            weight[np.concatenate([x >= r["docs"] for x, r in zip(refs, rows)])] = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
            at, flat = np.cumsum([0, *map(len, tokens)]), np.concatenate(tokens)
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
            total = np.add.reduceat(weight[order], first)
            n = np.empty(len(flat), np.uint8)
            scale = np.minimum(np.where(total < 16, total, 12 * np.log2(total) - 32), 255).astype(np.uint8)
            n[order] = np.repeat(scale, np.diff(np.append(first, len(flat))))
            for r, ref, a, b in zip(rows, refs, at[:-1], at[1:]):
                keep = n[a:b] > 1
                if keep.any():
                    yield _rows([{"slice": r["slice"], "bucket": r["bucket"], "docs": r["docs"], "tokens": flat[a:b][keep].tobytes(), "refs": ref[keep].tobytes(), "counts": n[a:b][keep].tobytes()}])

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _TRAVEL)


def described(shared: DataFrame, percent: int) -> DataFrame:
    """doc_id, size, node (hash of the set), grp (hash of size and prefix), alone (number of shingles that no other document
    holds), tokens (the other shingles in the global order, as bytes) and prefix (those of them that stand in the prefix) of every document."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        np.seterr(over="ignore")
        for rows in _by_key(batches, 0):
            (head,), rows = [r for r in rows if r["tokens"] is None], [r for r in rows if r["tokens"] is not None]
            none = np.zeros(0, np.uint64)
            token = np.concatenate([none, *(np.frombuffer(r["tokens"], np.uint64) for r in rows)])
            ref = np.concatenate([np.zeros(0, np.int64), *map(_refs, rows)]).astype(np.int64)
            n = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(r["counts"], np.uint8) for r in rows)])
            lists, length = np.frombuffer(head["refs"], np.uint32), np.frombuffer(head["counts"], np.uint32).astype(np.int64)
            start = np.cumsum(length) - length
            many = ref >= head["docs"]
            which = ref[many] - head["docs"]
            times = np.ones(len(ref), np.int64)
            times[many] = length[which]
            owner = np.repeat(ref, times)
            step = np.arange(times[many].sum()) - np.repeat(np.cumsum(times[many]) - times[many], times[many])
            owner[np.repeat(many, times)] = lists[np.repeat(start[which], times[many]) + step]
            token, n = np.repeat(token, times), np.repeat(n, times)
            order = np.lexsort((token, np.where(n >= OVERALL, n, 0), owner))
            token, owner = token[order], owner[order]
            size = np.array(head["sizes"], np.int64)
            at = np.searchsorted(owner, np.arange(len(size) + 1))
            alone = size - np.diff(at)
            inside = np.clip(np.where(size > 0, prefix_length(size, percent), 0) - alone, 0, None)
            node = np.array(head["nodes"], np.int64)
            grp = node.copy()
            for i in np.flatnonzero((alone == 0) & (size > 0)):
                grp[i] = (mix(token[at[i] : at[i] + inside[i]] * np.uint64(0xA24BAED4963EE407)).sum() + np.uint64(int(size[i]) * _BASE % (1 << 64))).view(np.int64)
            cuts = np.concatenate([[0], np.cumsum(inside)])
            pick = np.arange(cuts[-1]) - np.repeat(cuts[:-1], inside) + np.repeat(at[:-1], inside)
            prefix = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(token[pick].view(np.int64)))
            blobs = pa.array([token[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
            cols = [pa.array(head["ids"], pa.int64()), pa.array(size, pa.int32()), pa.array(node), pa.array(grp), pa.array(alone, pa.int32()), blobs, prefix]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "size", "node", "grp", "alone", "tokens", "prefix"])

    return shared.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "doc_id long, size int, node long, grp long, alone int, tokens binary, prefix array<long>")


def verify(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the threshold."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = np.zeros(len(batch), bool)
            m, n = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep[i] = 100 * both >= percent * (m[i] + n[i] - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    side = lambda k, t, n: classes.select(F.col("node").alias(k), F.col("tokens").alias(t), F.col("size").alias(n))
    return pairs.join(side("b", "right", "m"), "b").join(side("a", "left", "n"), "a").select("a", "b", "m", "n", "left", "right").mapInArrow(run, "a long, b long")


def components(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of every row."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, "jaccard")
    plain = text_of(docs, id_col, text_col)
    n_bytes = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (n_bytes // BUCKET).bit_length())
    every = tables.save(described(shared_shingles(dealt_shingles(plain, bits)), percent), "sets")
    tables.release()
    rows = every.where("doc_id is not null and length(tokens) > 0")
    classes = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("size", "grp", "alone", "tokens", "prefix")])
    classes = tables.save(classes, "classes")
    groups = classes.groupBy("grp").agg(F.min("size").alias("size"), F.min("alone").alias("alone"), F.min("node").alias("head"))

    # postings of groups: one row for each shingle of a group's prefix; only shingles of two groups or more can make pairs
    heads = classes.join(groups.select(F.col("head").alias("node")), "node", "left_semi")
    postings = heads.select("grp", "size", F.col("node").alias("head"), "alone", F.posexplode("prefix").alias("k", "token"))
    postings = postings.select("grp", "size", "head", (F.col("alone") + F.col("k")).alias("pos"), "token")
    lists = postings.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    postings = tables.save(postings.join(lists, "token"), "postings")
    tables.release()

    shorter, longer = F.least("size", "size2"), F.greatest("size", "size2")
    sized = 100 * shorter >= percent * longer

    # A group is first compared with a few others, so that most components are found without looking at all pairs of a list.
    # A pass cuts each list into small parts by another hash; one group of a part is its head, and every group
    # meets the PARTNERS heads with which it shares most, where both are in different components. What is left out here comes later.
    # After the first pass few lists are open; then lists are cut in PARTNERS ways, and a group meets all heads of its parts.
    # Passes end when no more pairs of different components are left in the lists than there were postings: all of these can be looked at.
    # Members of a group are compared with its head together with the first pass. A group goes by its head.
    within = classes.join(groups.select("grp", "head"), "grp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    spread, enough = postings.withColumn("component", F.col("head")), postings.count()
    comp = classes.select("node", "grp", F.col("node").alias("component"))
    for k in range(PASSES):
        seed = F.explode(F.array(*[F.lit(PARTNERS * k + i) for i in range(PARTNERS if k else 1)]))
        open_ = spread.withColumn("seed", seed).withColumn("part", F.pmod(F.xxhash64("head", "token", "seed"), F.ceil(F.col("n") / PART)))
        first = open_.groupBy("token", "seed", "part").agg(F.min(F.struct(F.xxhash64("head", "seed").alias("h"), "head", "size", "component")).alias("h"))
        first = first.select("token", "seed", "part", F.col("h.head").alias("head2"), F.col("h.size").alias("size2"), F.col("h.component").alias("component2"))
        met = open_.join(first, ["token", "seed", "part"]).where((F.col("component") != F.col("component2")) & sized)
        met = met.groupBy("head", "head2").agg(F.count("*").alias("shared"))
        if k == 0:
            best = met.groupBy("head").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", F.xxhash64("head2").alias("h"), "head2")), asc=False), 1, PARTNERS).alias("p"))  # at most as many heads as a prefix has shingles
            met = best.select("head", F.explode("p.head2").alias("head2"))
        pairs = met.select(F.col("head").alias("a"), F.col("head2").alias("b"))
        found = _verified(classes, pairs if k else pairs.union(within), percent, tables, f"pass{k}")
        comp = _components(comp, found, tables, f"comp{k}")
        tables.drop(f"spread{k}")
        spread = tables.save(_open(postings, comp, percent), f"spread{k + 1}")
        tables.release()
        own = spread.groupBy("token", "component").agg(F.count("*").alias("m"), F.first("n").alias("n"))
        left = own.agg(F.sum(F.expr("m * (n - m) / 2")).alias("pairs")).first().pairs
        if left is None or left <= enough or found.isEmpty():
            break

    # What is left: pairs of groups between different components, filtered by size and by the place of the shingle. The first
    # shingle that two sets share must stand so early in both that what is behind it suffices for the threshold.
    tables.drop("postings")
    other = spread.select("token", *[F.col(c).alias(f"{c}2") for c in ("grp", "size", "component", "pos")])
    early = lambda size, pos: (100 + percent) * (F.col(size) - F.col(pos)) >= percent * (F.col("size") + F.col("size2"))
    met = spread.join(other, "token").where((F.col("component") < F.col("component2")) & sized & early("size", "pos") & early("size2", "pos2"))
    met = met.select("grp", "component", "grp2", "component2").distinct()
    a = comp.select(F.col("node").alias("a"), "grp", "component")
    b = comp.select(F.col("node").alias("b"), F.col("grp").alias("grp2"), F.col("component").alias("component2"))
    left = met.join(a, ["grp", "component"]).join(b, ["grp2", "component2"]).select("a", "b")
    several = comp.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("grp")
    same = a.join(several, "grp").join(b.withColumnRenamed("grp2", "grp"), "grp").where("component < component2").select("a", "b")
    found = _verified(classes, left.union(same), percent, tables, "left")
    comp = _components(comp, found, tables, "comp")

    # back to documents: the smallest id of each component; what shares no shingle with any other is alone
    least = comp.join(classes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = comp.join(least, "component").select("node", "component_id")
    out = every.select("doc_id", "size", "node").join(of, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), component.alias("component_id"))


def _open(postings: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """The postings in lists that still hold several components, with the component and the length of the list.

    A posting that stands so late in its prefix that no set of the list is small enough to be linked over it is left out;
    it would only matter if it were the first shingle that two sets share.
    """
    spread = postings.select("token", "grp", "head", "size", "pos").join(comp.select("grp", "component").distinct(), "grp")
    of = spread.groupBy("token").agg(F.min("size").alias("least"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
    reach = (100 + percent) * (F.col("size") - F.col("pos")) >= percent * (F.col("size") + F.greatest("least", F.expr(f"({percent} * size + 99) div 100")))
    return spread.join(of.where("lo <> hi"), "token").where(reach).drop("least", "lo", "hi")


def _verified(classes: DataFrame, pairs: DataFrame, percent: int, tables: Tables, name: str) -> DataFrame:
    """The links among ``pairs`` of nodes."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return tables.save(verify(pairs, classes, percent), f"links-{name}")


def _components(comp: DataFrame, links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """node, grp, component of every class, after the components of ``comp`` that ``links`` connect have become one (the smallest)."""
    if links.isEmpty():
        return comp
    a, b = (comp.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}")) for k in ("a", "b"))
    ends = links.join(a, "a").join(b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    found = connected_components(ends, tables, name).select(F.col("node").alias("component"), F.col("component").alias("root"))
    joined = comp.join(found, "component", "left").select("node", "grp", F.coalesce("root", "component").alias("component"))
    return tables.save(joined, f"{name}-all")


def representatives(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents (doc_id, text, any others) with one of each component: that with the smallest id. Rows without id stay."""
    found = components(docs, percent)
    gone = found.where("component_id is not null and doc_id <> component_id").select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # rows that share an id are rare: only then are equal ones looked for
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return out
    named = out.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return named.unionByName(out.where("doc_id is null"))
