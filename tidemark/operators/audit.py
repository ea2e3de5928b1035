"""Reconciliation of two tables by digests of hash ranges, and repair of what one lacks.

Keys are cut into ranges by their hash. First each range of both sides is digested (number of rows, sums of their hashes): tasks combine
before the shuffle, so a range costs one row a task, whatever the tables' size. Ranges that differ are digested once more in finer ones, and only
rows of fine ranges that differ are compared key by key. Two tables that agree but for a few rows so shuffle little more than these rows.
Digests are sums of 64-bit hashes: that two different ranges look equal has a chance of about 2^-64.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kept import saved
from ..sources.versions import VersionedTable

#: Ranges of the first digest, and finer ones in each of them: what is broadcast is bounded by their product.
FIRST, SECOND = 4096, 64


def hashed(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, h, coarse, fine): a hash of the compared columns (nulls have a place of their own), and the key's range."""
    spot = F.xxhash64(*[F.struct(F.col(f"`{k}`")) for k in key])
    content = F.xxhash64(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in [*key, *columns]])
    return rows.select(*[F.col(f"`{k}`") for k in key], content.alias("h"), F.pmod(spot, F.lit(FIRST)).cast("int").alias("coarse"), F.pmod(F.shiftright(spot, 32), F.lit(SECOND)).cast("int").alias("fine"))


def digested(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each of ``by``: how many rows, and sums of the halves of their hashes (no sum can overflow below 2^31 rows)."""
    return rows.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.struct(F.count("*").alias("n"), F.sum(F.shiftright("h", 32)).alias("hi"), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("lo"), F.bit_xor("h").alias("x")).alias("d"))


def differing(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(by, l, r): digests of both sides where they differ; null where a side has no rows."""
    a, b = digested(left, by).withColumnRenamed("d", "l"), digested(right, by).withColumnRenamed("d", "r")
    same = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in by]
    both = a.alias("a").join(b.alias("b"), same, "full").where(~F.col("l").eqNullSafe(F.col("r")))
    return both.select(*[F.coalesce(F.col(f"a.`{c}`"), F.col(f"b.`{c}`")).alias(c) for c in by], "l", "r")


def reconcile(left: DataFrame, right: DataFrame, key: list[str], columns: list[str] | None = None, report: dict | None = None) -> DataFrame:
    """[JN-4, ST-3, STM-21] (key, side) of all keys that differ: ``missing`` (left only), ``orphan`` (right only), ``changed`` (other rows).

    Without ``columns`` only the keys are compared (and how often each stands on a side). Null keys are keys. Empty tables are allowed.
    ``report`` receives how many ranges differ and how many rows were compared key by key.
    """
    a, b = (saved(hashed(rows, key, columns or []), "digest") for rows in (left, right))
    coarse = saved(differing(a, b, ["coarse"]).select("coarse"), "coarse")
    inside = lambda rows: rows.join(F.broadcast(coarse), "coarse", "left_semi")  # noqa: E731  at most FIRST rows
    fine = saved(differing(inside(a), inside(b), ["coarse", "fine"]).select("coarse", "fine"), "fine")
    compared = [rows.join(F.broadcast(fine), ["coarse", "fine"], "left_semi") for rows in (a, b)]  # at most FIRST * SECOND rows
    if report is not None:
        report |= {"coarse": coarse.count(), "fine": fine.count(), "rows": sum(c.count() for c in compared)}
    found = differing(*compared, key)
    return found.select(*key, F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "orphan").otherwise("changed").alias("side"))


def to_push(left: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """[STM-21] The rows of the left side that the right one lacks or has otherwise; orphans are reported, never removed."""
    keys = found.where("side <> 'orphan'").select(*[F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(key)])
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(key)]
    return left.join(keys, same, "left_semi")


def repair(left: DataFrame, table: VersionedTable, columns: list[str] | None = None) -> dict[str, int]:
    """[STM-21] Push what a versioned table lacks, once: a second repair finds nothing to push. How many keys were missing, changed and orphans."""
    names = columns if columns is not None else [c for c in table.schema.names if c not in table.key]
    found = saved(reconcile(left, table.read(), table.key, names), "differences")
    count = {r.side: r["count"] for r in found.groupBy("side").count().collect()}
    if count.get("missing") or count.get("changed"):
        table.upsert(to_push(left.select(*table.schema.names), found, table.key))
    return {side: count.get(side, 0) for side in ("missing", "changed", "orphan")}
