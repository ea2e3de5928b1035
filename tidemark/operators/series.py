"""Series manifests: monotone states, gaps, histograms, overviews, names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import STATES
from ..functions.text import table_cell


def state_number(state) -> F.Column:
    """Position of a state in the order pending < raw_ready < summarized < landed < verified; unknown names count as pending."""
    return F.greatest(F.lit(0), F.array_position(F.array(*map(F.lit, STATES)), state).cast("int") - 1)


def state_name(number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, STATES)), number + 1)


def fold(evidence: DataFrame) -> DataFrame:
    """[AG-16, STM-15, STM-16] The highest state that any evidence proves, for each (series, page)."""
    out = evidence.groupBy("series", "page").agg(F.max(state_number(F.col("state"))).alias("ord"), F.count("*").alias("n_evidence"))
    return out.select("series", "page", state_name(F.col("ord")).alias("state"), "ord", "n_evidence")


def histogram(manifest: DataFrame) -> DataFrame:
    """[AG-2] Pages by state, in columns."""
    return manifest.groupBy("series").agg(F.count("*").cast("int").alias("total"), *[F.count_if(F.col("state") == s).cast("int").alias(s) for s in STATES])


def gaps(manifest: DataFrame, expected: DataFrame, least: str = "raw_ready") -> DataFrame:
    """[JN-9] Pages from 1 to the expected total that have not reached a state."""
    wanted = expected.where("expected_total > 0").select("series", F.explode(F.sequence(F.lit(1), F.col("expected_total"))).alias("page"))
    return wanted.join(manifest.where(F.col("ord") >= STATES.index(least)).select("series", "page"), ["series", "page"], "left_anti")


def grow_total(old: DataFrame, new: DataFrame) -> DataFrame:
    """[STM-18] Expected totals only grow."""
    return old.unionByName(new).groupBy("series").agg(F.max("expected_total").alias("expected_total"))


def pending(bases: DataFrame, done: DataFrame) -> DataFrame:
    """[JN-2, JN-6, JN-10, STM-19] Bases that are not done."""
    return bases.join(done.select("series", "base"), ["series", "base"], "left_anti")


def fill(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """[STM-17] Non-empty new values override old ones, empty ones don't."""
    o, n = old.select(*key, *[F.col(f).alias(f"old_{f}") for f in fields]), new.select(*key, *[F.col(f).alias(f"new_{f}") for f in fields])
    return o.join(n, key, "full").select(*key, *[F.coalesce(F.nullif(f"new_{f}", F.lit("")), f"old_{f}").alias(f) for f in fields])


def overview(notes: DataFrame) -> DataFrame:
    """[JSN-11, SO-1, O1] A table of pages and a chain of titles for every series; a series is bounded by its pages."""
    rows = F.sort_array(F.collect_list(F.struct("page", table_cell("title").alias("title"))))
    out = notes.groupBy("series").agg(rows.alias("r"))
    table = F.array_join(F.transform("r", lambda x: F.concat(F.lit("| "), x["page"].cast("string"), F.lit(" | "), x["title"], F.lit(" |"))), "\n")
    return out.select("series", table.alias("navigation"), F.array_join(F.transform("r", lambda x: x["title"]), " → ").alias("path"))


def expand_playlist(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """[SRC-13, SRC-14, SO-4] One row for each entry of (series, entries), with its place; the first ``limit`` of each if given."""
    e = F.slice("entries", 1, limit) if limit else F.col("entries")
    return entries.select("series", F.posexplode(e).alias("position", "entry"))


def unique_names(notes: DataFrame, name: str, *order: str) -> DataFrame:
    """[SNK-11, WN-13] A name that is taken gets -1, -2 and so on."""
    k = F.row_number().over(W.partitionBy(name).orderBy(*order)) - 1
    suffixed = F.concat(F.regexp_replace(name, r"\.md$", ""), F.lit("-"), k.cast("string"), F.lit(".md"))
    return notes.withColumn("unique_name", F.when(k == 0, F.col(name)).otherwise(suffixed))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """[JN-12] Full paths (node, path, depth) of (node, parent, title), of any depth, for all nodes that a root leads to.

    Pointer doubling: every node holds the path from an ancestor down to itself, and each round replaces the ancestor by the
    one that it points to, so the rounds are the logarithm of the depth. Nodes on a cycle, or below one, are an error; nodes whose
    parent does not exist are left out. Rounds are cut by checkpoints where the session has a folder for them.
    """
    spark = nodes.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if folder and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    kept = folder or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    paths = nodes.select("node", F.col("parent").alias("up"), F.col("title").alias("path"), F.lit(0).alias("depth"))
    most = max(nodes.count(), 1).bit_length() + 1
    for _ in range(most):
        paths = paths.checkpoint() if kept else paths.persist()
        if paths.where("up is not null").isEmpty():
            return paths.select("node", "path", "depth")
        above = paths.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"), F.col("depth").alias("more"))
        whole = paths.where("up is null")
        step = paths.where("up is not null").join(above, "up").select("node", F.col("next").alias("up"), F.concat("head", F.lit("/"), "path").alias("path"), (F.col("depth") + F.col("more") + 1).alias("depth"))
        paths = whole.unionByName(step)
    raise ValueError("the parents of some nodes form a cycle")


def child_by_title(children: DataFrame, wanted: DataFrame) -> DataFrame:
    """[JN-5] (parent, title, node) of wanted (parent, title): the first node of that title below the parent, null if there is none."""
    first = children.groupBy("parent", "title").agg(F.min("node").alias("node"))
    return wanted.select("parent", "title").distinct().join(first, ["parent", "title"], "left")


def summaries_of(queue: DataFrame, files: DataFrame, mark: str = "_raw_") -> DataFrame:
    """[JN-8] Queue entries (raw, ...) with the summary file that stands for them: its path is the raw one without the mark."""
    wanted = queue.withColumn("path", F.regexp_replace("raw", mark, ""))
    return wanted.join(files.select("path", F.lit(True).alias("found")).distinct(), "path", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def drain(manifest: DataFrame, saved: DataFrame, least: str = "verified") -> DataFrame:
    """[STM-14] Series with a state after a batch of saved pages: pages saved become landed, landed ones that are also found at the
    target become verified, and the raw files of a series may be cleaned up only when all its pages are verified.

    ``manifest`` (series, page, ord) may hold a page several times; its highest state counts. Both tables go into one grouping by page, so no
    task holds sorted sides of a join. Pages hardly repeat, so rows are dealt before they are grouped, into as many parts as the session
    shuffles into: a hash table of what one task reads, or of parts that were joined for their small bytes, would be far larger."""
    none = F.lit(None).cast("boolean")
    rows = manifest.select("series", "page", F.coalesce("ord", F.lit(0)).alias("ord"), none.alias("ok"), none.alias("found"))
    proof = saved.where("series is not null and page is not null")  # an unknown page proves nothing
    rows = rows.unionByName(proof.select("series", "page", F.lit(None).cast("int").alias("ord"), "ok", "found"))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series", "page")
    pages = rows.groupBy("series", "page").agg(F.max("ord").alias("old"), F.bool_or("ok").alias("ok"), F.bool_or("found").alias("found")).where("old is not null")
    new = F.when(F.col("ok") & F.col("found"), STATES.index("verified")).when(F.col("ok"), STATES.index("landed")).otherwise(0)
    pages = pages.select("series", F.greatest("old", new).alias("ord"))
    return pages.groupBy("series").agg(F.count("*").alias("pages"), F.count_if(F.col("ord") >= STATES.index("landed")).alias("landed"), F.count_if(F.col("ord") >= STATES.index(least)).alias("verified"), F.bool_and(F.col("ord") >= STATES.index(least)).alias("clean_up"))


def missing_folders(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """[SNK-7] All prefixes of the paths that do not exist yet."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return paths.where("path <> ''").select(F.explode(prefixes).alias("path")).distinct().join(existing, "path", "left_anti")


def two_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """[JN-4, ST-3, STM-21] Keys of one side only: missing (left only) and orphan (right only)."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full").where("l is null or r is null").select(key, F.when(F.col("r").isNull(), "missing").otherwise("orphan").alias("side"))
