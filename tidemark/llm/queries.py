"""Registered queries of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import components

    return components(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove

    return remove(table(spark, sf_dir, "documents"), digest=True)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other vectors, by Hamming distance of sign codes, of every vector whose id is divisible by 20."""
    from .embeddings import sign_code, top_k

    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    asked = codes.where("id % 20 = 0").select(F.col("id").alias("query_id"), "code")
    return top_k(codes, asked, 10)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), digest=True)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import group

    return group(table(spark, sf_dir, "documents"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periods import find

    return find(table(spark, sf_dir, "documents"), plant=True, digest=True)


_ALL = (op1_packing, op2_quality, op3_jaccard, op4_secrets, op5_language, op6_substrings, op7_embeddings, op8_toxicity, op9_topk, op10_bpe, op11_pii, op12_variants, op13_periods)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {
    "op3_jaccard": r"""
        with recursive w as (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws
            from documents),
        s as (
            select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
                else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) sh from w),
        e as (select * from (select doc_id, hash(t) t from (select doc_id, unnest(sh) t from s)) qualify count(*) over (partition by t) > 1),
        p as (select a.doc_id a, b.doc_id b, count(*) c from e a join e b on a.t = b.t and a.doc_id <> b.doc_id group by 1, 2),
        l as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * c >= 75 * (len(x.sh) + len(y.sh) - c)),
        r as (select doc_id node, doc_id reached from s union select r.node, l.b from r join l on r.reached = l.a)
        select doc_id, len(sh)::bigint n_shingles, least(doc_id, m) component_id from s join (select node, min(reached) m from r group by 1) on node = doc_id""",
    "op7_embeddings": """
        with recursive v as (select vec_id, embedding::double[] e from embeddings),
        l as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
        r as (select vec_id node, vec_id reached from v union select r.node, l.b from r join l on r.reached = l.a),
        c as (select node, min(reached) component_id from r group by 1)
        select vec_id, (select count(*) from l where a = vec_id) n_links, component_id, vec_id = component_id kept from v join c on node = vec_id""",
    "op9_topk": """
        with bits as (
            select vec_id, len(embedding) n, array_to_string(list_transform(embedding, lambda x: case when x > 0 then '1' else '0' end), '')::bit as code
            from embeddings where vec_id is not null and len(embedding) > 0),
        pairs as (
            select q.vec_id query_id, r.vec_id id, bit_count(xor(q.code, r.code))::int distance
            from bits q join bits r on q.vec_id % 20 = 0 and q.vec_id <> r.vec_id and q.n = r.n)
        select query_id, id, distance, row_number() over (partition by query_id order by distance, id)::int as rank
        from pairs qualify row_number() over (partition by query_id order by distance, id) <= 10""",
}
