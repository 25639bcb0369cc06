"""Result lines: classification, counts, answers of batches, documents made of answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.functions.text import is_uuid, nonblank, strip_ws
from promptmill.operators.numbering import number_rows, ordered_concat
from promptmill.operators.upserts import upsert

# Separators and page frame of extracted documents.
TEXT_SEPARATOR = "\n\n---\n\n"
PAGE_HEAD = (
    '<!doctype html>\n<html lang="en">\n<head>\n'
    '<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<title>'
)
PAGE_STYLE = (
    "</title>\n<style>body{font-family:system-ui,Segoe UI,Roboto,Helvetica,Arial,sans-serif;line-height:1.6;padding:24px}"
    ".container{max-width:900px;margin:0 auto}.prose h1,h2,h3{line-height:1.25}</style>\n"
    '</head>\n<body>\n<main class="container">\n<div id="content" class="prose">\n'
)
PAGE_FOOT = "\n</div>\n</main>\n</body>\n</html>\n"


def classify_lines(decoded: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``line_class``: invalid, no_id, skipped (id already stored) or new.

    Lines without an id get a per-row stand-in as join key, because equal NULL keys would all
    be shuffled into one partition.
    """
    salt = F.concat(F.lit("\0"), F.xxhash64(*[F.col(c) for c in decoded.columns if c != "root"]).cast("string"))
    known = existing.select(F.col("custom_id").alias("_key")).distinct().withColumn("_known", F.lit(True))
    joined = decoded.withColumn("_key", F.coalesce("custom_id", salt)).join(known, "_key", "left")
    return joined.withColumn(
        "line_class",
        F.when(~F.col("line_ok"), "invalid").when(F.col("custom_id").isNull(), "no_id").when(F.col("_known"), "skipped").otherwise("new"),
    ).drop("_key", "_known")


def fetch_counts(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return classified.groupBy(*by).agg(
        F.count_if(F.col("line_class") == "new").alias("downloaded"),
        F.count_if(F.col("line_class") == "skipped").alias("skipped_existing"))


def extract_counts(extracted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, extracted and skipped lines."""
    ok = F.col("content").isNotNull()
    return extracted.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("bad"))


def answer_class() -> Column:
    """Why a result line is good or rejected; rejects are kept as rows instead of being lost."""
    return (
        F.when(~F.col("line_ok"), "invalid_json").when(F.col("custom_id").isNull(), "no_custom_id")
        .when(F.col("content").isNull(), "no_text").when(~is_uuid("custom_id"), "bad_request_id").otherwise("good"))


def split_good_bad(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good lines and rejects. Both read ``extracted``; write it first when both are wanted whole."""
    marked = extracted.withColumn("answer_class", answer_class())
    return marked.where(F.col("answer_class") == "good"), marked.where(F.col("answer_class") != "good")


def nonblank_content(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn(content, strip_ws(content)).where(F.col(content) != "")


def blank_to_null(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn(content, nonblank(content))


def new_results_only(results: DataFrame, existing: DataFrame) -> DataFrame:
    return results.join(existing.select("custom_id").distinct(), "custom_id", "left_anti")


def last_per_id(results: DataFrame, order: str) -> DataFrame:
    """Of repeated ids the last line counts (a later file write replaced an earlier one)."""
    rest = [c for c in results.columns if c != "custom_id"]
    return results.groupBy("custom_id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("custom_id", "_r.*")


_PAIR = ["batch_fk", "request_fk"]


def allowed_answers(answers: DataFrame, batch_requests: DataFrame) -> DataFrame:
    """Answers whose request belongs to the batch. The join key is the pair, so a big batch spreads out."""
    return answers.join(batch_requests.select(*_PAIR), _PAIR, "left_semi")


def missing_answers(answers: DataFrame, batch_requests: DataFrame) -> DataFrame:
    return batch_requests.join(answers.select(*_PAIR).distinct(), _PAIR, "left_anti")


def answers_materialized(answers: DataFrame, batch_requests: DataFrame) -> DataFrame:
    """Per batch: answered, missing and all requests, and answers that belong to no request of it.

    One full outer join on the pair, then one pre-aggregated count.
    """
    a = answers.select(*_PAIR).distinct().withColumn("_a", F.lit(True))
    r = batch_requests.select(*_PAIR).distinct().withColumn("_r", F.lit(True))
    has_a, has_r = F.col("_a").isNotNull(), F.col("_r").isNotNull()
    return a.join(r, _PAIR, "full_outer").groupBy("batch_fk").agg(
        F.count_if(has_a & has_r).alias("ok_count"), F.count_if(~has_a & has_r).alias("missing_count"),
        F.count_if(has_r).alias("batch_request_count"), F.count_if(has_a & ~has_r).alias("foreign_count"))


def batch_request_count(batch_requests: DataFrame) -> DataFrame:
    return batch_requests.groupBy("batch_fk").agg(F.count(F.lit(1)).alias("request_count"))


def upsert_results(existing: DataFrame, incoming: DataFrame, order: Sequence[str], created_at: Column) -> DataFrame:
    """Insert or replace answers; absent content is stored as empty text, absent metadata as JSON null."""
    filled = incoming.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("metadata", F.coalesce("metadata", F.lit("null")))
    return upsert(existing, filled, _PAIR, ["metadata", "content"], order, {"created_at": created_at})


def fetch_summary(classified: DataFrame, statuses: DataFrame, by: Sequence[str]) -> DataFrame:
    """One summary row per batch: status, counts of the fetch, the provider's own counts."""
    return statuses.join(fetch_counts(classified, by), list(by), "left").fillna(0, ["downloaded", "skipped_existing"])


def extracted_document(
    texts: DataFrame, keys: Sequence[str], order_by: Sequence[str], text: str, render: Column | None = None, chunk_rows: int = 500,
) -> DataFrame:
    """HTML pages made of the texts of each group, as ordered parts: (keys, part_no, part).

    Part 0 is the page head (the title is the first line of the joined text), then come the
    text chunks and last the page foot. ``render`` may turn ``chunk`` into HTML; it defaults to the text.
    """
    chunks = ordered_concat(texts, keys, order_by, text, TEXT_SEPARATOR, chunk_rows, "_chunks")
    no, title = F.col("chunk_no"), F.substring_index("chunk", "\n", 1)

    def part(at: Column, value: Column) -> Column:
        return F.struct(at.cast("bigint").alias("part_no"), value.alias("part"))

    parts = F.array_compact(F.array(
        F.when(no == 0, part(F.lit(0), F.concat(F.lit(PAGE_HEAD), title, F.lit(PAGE_STYLE)))),
        part(no + 1, F.col("chunk") if render is None else render),
        F.when(no == F.col("_chunks") - 1, part(no + 2, F.lit(PAGE_FOOT)))))
    return chunks.select(*keys, F.inline(parts))


def write_documents(parts: DataFrame, keys: Sequence[str], path: str) -> None:
    """Write document parts in order; a document is its lines read in file order."""
    parts.repartitionByRange(*keys, "part_no").sortWithinPartitions(*keys, "part_no").write.parquet(path)


def item_index(df: DataFrame, production: str, order_by: Sequence[str]) -> DataFrame:
    return number_rows(df, order_by, [production], "item_index")
