"""Registered queries of the training-text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.llm import (
    bpe, decontaminate, hard_negatives, jaccard, language_id, license_scan, merkle, suffix_dedup, token_counts, token_files, url_filter, vptree, warc)
from promptmill.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@query(f"""
    with rules(verdict, rhost, rpath) as (values {', '.join(str(r) for r in URL_RULES)}),
    rest as (
      select row_number() over () as n, page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    parsed as (
      select n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from rest),
    fits as (
      select n, arg_max(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) as won
      from parsed join rules on (host = rhost or host like '%.' || rhost) and starts_with(path, rpath) group by n)
    select page_id, host, path, won.rule as rule, coalesce(won.verdict, 'allow') as verdict from parsed left join fits using (n)""")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


@query(f"""
    with p as (select page_id, coalesce(html, '') as html from pages),
    d as (select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest from p),
    k as (select payload_digest, max(page_id) as kept, count(*) as n from d where payload_bytes >= {warc.REVISIT_BYTES} group by payload_digest),
    j as (select d.*, case when n > 1 and page_id <> kept then kept end as refers_to from d left join k using (payload_digest))
    select page_id, payload_bytes, payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to from j""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), out)
    found = warc.read(spark, out, payload=False).where("kind = 'record'")
    return found.select(
        warc.page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number(F.col("refers_to")).alias("refers_to"))


@query()
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), out, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return token_files.checksums(spark, out)


@query("""
    with good as (
      select vec_id, embedding::double[] as v from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    scored as (
      select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score from good q join good c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
    ranked as (
      select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored)
    select * from ranked where rank <= 20""")
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, factor=1.0)


@query()
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


@query()
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), ["doc_id"])


@query(license_scan.twin())
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query()
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(~language_id.held_out()))
    judged = language_id.identify(docs.select("doc_id", language_id.held_out().alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return judged.select("doc_id", "held_out", "lang_pred", "score", "hit_share")


@query()
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


@query()
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), ["doc_id"])


@query(hard_negatives.twin())
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    # labels that are wrong on purpose, so that the mining has something to find
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query(merkle.twin())
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(
        table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], merkle.even_checksum(), {"text": F.replace("text", F.lit("\n"), F.lit(""))})
