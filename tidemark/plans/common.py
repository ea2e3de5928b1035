from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from .. import config
from ..config import DEFAULT

#: The time at which all registered queries look at the data.
NOW = "2024-01-20 00:00:00"
#: Word lists for the registered queries: the tables hold invented prose, in which the default words hardly occur.
PROSE = replace(
    DEFAULT, ad_titles=("Licensed under", "Copyright", "password=", "Thion", "Ention"), ad_phrases=("Licensed under", "Apache License", "CC BY", "token = ", "password=", "thing the", "on the"),
    ad_strong=("Licensed under", "password=", "AKIA"), wall_markers=(*DEFAULT.wall_markers, "%%%"), tutorial=(*DEFAULT.tutorial, "thethe"), interview=(*DEFAULT.interview, "heand"), key_points=(*DEFAULT.key_points, "ionth"),
    roundup=(*DEFAULT.roundup, "sthe"), reading=(*DEFAULT.reading, "reent"), opinion=(*DEFAULT.opinion, "ndst"), case=(*DEFAULT.case, "wher"), host_probes=("tell us", "the the", "of the"), audience_probes=("asks", "and the"),
    tag_terms=("the", "und", "que", "ción", "Licensed", "tion", "lich"),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_any(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def sql_hits(column: str, words) -> str:
    return "(" + " + ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')::int" for w in words) + ")"


def sql_occurrences(column: str, words) -> str:
    return "(" + " + ".join(f"((length({column}) - length(replace({column}, '{w}', ''))) // {len(w)})" for w in words) + ")"


def sql_chunks(source: str, key: str, most: int, overlap: int, back: int = config.CHUNK_LOOKBACK) -> str:
    """Chunks (key, chunk, text) of the texts of ``source``, as a recursive query: the rules written down once more, independent of the operator."""
    white, back = "' ' || chr(9) || chr(10) || chr(13)", min(most, back)
    kinds = ["chr(10)", *(f"'{c}'" for c in config.SEPARATORS), "' '"]
    last = ", ".join(f"b + {most - back} + length(w) - nullif(strpos(reverse(w), {c}), 0) + 1" for c in kinds)
    step = f"select {key}, t, n, b s, case when n - b <= {most} then n else coalesce({last}, b + {most}) end e from (select *, substr(t, b + {most - back} + 1, {back}) w from {{}})"
    return f"""(with recursive t as (select {key}, trim(text, {white}) t from {source}), u as (select {key}, t, length(t) n, 0::bigint b from t where t <> ''),
        c as ({step.format("u")} union all {step.format(f"(select {key}, t, n, greatest(e - {overlap}, s + 1) b from c where e < n)")}),
        p as (select {key}, s, trim(substr(t, s + 1, e - s), {white}) x from c)
        select {key}, (row_number() over (partition by {key} order by s) - 1)::int chunk, x as text from p where x <> '')"""


def sql_summary(most: int) -> str:
    """The extractive provider of a column ``text``."""
    return f"nullif(trim(substr(regexp_extract(trim(text), '^[^.!?]*[.!?]?'), 1, {most})), '')"
