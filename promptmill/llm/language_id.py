"""Language identification with language-bitmask trigram filters.

Learning counts the letter trigrams of every labelled text (lower-cased, every run of other
characters being one blank) and keeps for a language those that make up at least ``MIN_SHARE``
of its trigrams and are not much rarer there than in its most typical language. These sets go
into one bit-sliced Bloom filter: a table of words in which bit *l* belongs to language *l*, so
that the bitwise AND of the ``HASHES`` probed words is the set of all languages containing a
trigram. The text's popcount per language, corrected for the filter's false positives, decides.

``MIN_SHARE`` bounds the model: no language can have more than ``1 / MIN_SHARE`` trigrams.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm.tasks import CACHES, arrow_map, ddl
from promptmill.llm.words import mixed
from promptmill.session import cut_lineage

MIN_SHARE = 1e-5  # least share of a language's trigrams
RATIO = 0.5  # least share against the language in which the trigram is most usual
HASHES = 4
BITS_PER_ENTRY = 16
LANES = 63  # languages per table word
UNKNOWN = "und"
SLICE_CHARS = 1_000_000


def _letters() -> np.ndarray:
    """1 for every code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_table: list[np.ndarray] = []
CACHES.append(_table)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams (three code points in 63 bits), the first of each text, and whether it has a letter."""
    if not _table:
        _table.append(_letters())
    chars = np.frombuffer("".join(f" {t.lower()} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(t.lower()) + 2 for t in texts), np.int64, len(texts))
    begin = np.concatenate(([0], np.cumsum(size)))
    letter = _table[0][chars]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each run of letters
    keep[begin[:-1]] = True  # and one before the first
    code = np.where(letter, chars, 32)[keep].astype(np.int64)
    at = np.concatenate(([0], np.cumsum(keep)))[begin]
    count = np.maximum(np.diff(at) - 2, 0)
    first = np.concatenate(([0], np.cumsum(count)))
    gram = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:] if len(code) > 2 else np.zeros(0, np.int64)
    inner = np.ones(len(gram), bool)
    for back in (1, 2):  # those that reach over the end of a text
        stop = at[1:] - back
        inner[stop[(stop >= 0) & (stop < len(gram))]] = False
    return gram[inner], first, np.diff(np.concatenate(([0], np.cumsum(letter)))[begin]) > 0


def text_slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about ``limit`` characters with the place of the first; null is empty."""
    part: list[str] = []
    at = size = 0
    for i, t in enumerate(texts):
        if part and size + len(t or "") > limit:
            yield at, part
            part, at, size = [], i, 0
        part.append(t or "")
        size += len(t or "")
    if part:
        yield at, part


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, text = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
        for one in sorted(set(lang)):
            mine = [text[i] for i in np.flatnonzero(lang == one)]
            for _, part in text_slices(mine):
                gram, n = np.unique(trigrams(part)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


@dataclass
class Model:
    """Languages in bit order, the table (slices x words), and the false positive rate of each language."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray


def _slots(gram, size: int) -> list[np.ndarray]:
    a = mixed(gram.view(np.uint64))
    b = mixed(a + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit the filters on all rows whose text and language are not null.

    The trigram counts are Spark aggregates; what reaches the driver is at most
    ``1 / MIN_SHARE`` trigrams per language.
    """
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = arrow_map(labelled, _count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    per_lang = F.struct("lang", F.col("n").cast("double").alias("n"))
    # one row per trigram with its counts by language, then shares: languages are few
    by_gram = counts.groupBy("gram").agg(F.collect_list(per_lang).alias("by"))
    by_gram = cut_lineage(by_gram, "trigrams")
    totals = {r["lang"]: r["n"] for r in by_gram.select(F.explode("by").alias("e")).groupBy("e.lang").agg(F.sum("e.n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        labels = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
        return Model(labels, np.zeros((1, 64), np.uint64), np.zeros(len(labels)))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(1.0 / totals[k]))])
    shares = F.transform("by", lambda e: F.struct(e["lang"].alias("lang"), (e["n"] * F.element_at(share, e["lang"])).alias("s")))
    typical = F.filter(F.col("shares"), lambda e: (e["s"] >= MIN_SHARE) & (e["s"] >= RATIO * F.array_max(F.transform("shares", lambda x: x["s"]))))
    kept = by_gram.select("gram", shares.alias("shares")).select("gram", F.transform(typical, lambda e: e["lang"]).alias("langs")).where(F.size("langs") > 0)
    rows = kept.toArrow()
    gram = rows.column("gram").to_numpy().astype(np.int64)
    of = rows.column("langs").combine_chunks()
    number = {k: i for i, k in enumerate(languages)}
    lane = np.array([number[k] for k in of.flatten().to_pylist()], np.int64)
    owner = np.repeat(np.arange(len(gram)), np.diff(of.offsets.to_numpy()))
    size = 1 << max(6, (BITS_PER_ENTRY * int(np.bincount(lane, minlength=1).max())).bit_length())
    table = np.zeros(((len(languages) - 1) // LANES + 1, size), np.uint64)
    for slot in _slots(gram, size):
        np.bitwise_or.at(table, (lane // LANES, slot[owner]), np.uint64(1) << (lane % LANES).astype(np.uint64))
    fill = [np.mean((table[i // LANES] >> np.uint64(i % LANES)) & np.uint64(1)) for i in range(len(languages))]
    return Model(languages, table, np.array(fill) ** HASHES)


def judge(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score (share of the corrected evidence, 0 to 1) and hit share of the winner for each text."""
    gram, first, has_letter = trigrams(texts)
    slots = _slots(gram, model.table.shape[1])
    total = np.diff(first).astype(np.float64)
    found = np.zeros((len(texts), len(model.languages)))
    for s, words in enumerate(model.table):
        mask = words[slots[0]]
        for slot in slots[1:]:
            mask &= words[slot]
        for i in range(s * LANES, min((s + 1) * LANES, len(model.languages))):
            hits = np.concatenate(([0], np.cumsum((mask >> np.uint64(i % LANES)) & np.uint64(1), dtype=np.int64)))
            found[:, i] = hits[first[1:]] - hits[first[:-1]]
    wrong = total[:, None] * model.false_rate[None, :]
    real = np.clip((found - wrong) / np.maximum(1 - model.false_rate, 1e-9), 0, None)  # expected true hits
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    best = real.argmax(1)
    top, everything = real[np.arange(len(texts)), best], real.sum(1)
    score = np.where(has_letter & (everything > 0), top / np.maximum(everything, 1e-12), 0.0)
    share = np.where(has_letter & (total > 0), np.minimum(top / np.maximum(total, 1), 1), 0.0)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)], score, share


def identify(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` of every row with ``lang_pred``, ``score`` and ``hit_share``.

    A null text and a text without a letter are ``und`` with score 0; so is every text where
    nothing was learned. A text of letters without any known trigram gets the first language, score 0.
    """
    chosen = docs.select(*keys, F.col(text).cast("string").alias("_text"))

    def run(batches):
        for batch in batches:
            for at, part in text_slices(batch.column("_text").to_pylist()):
                lang, score, share = judge(model, part)
                own = [batch.column(k).slice(at, len(part)) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score), pa.array(share)], [*keys, "lang_pred", "score", "hit_share"])

    return arrow_map(chosen, run, f"{ddl(chosen, keys)}, lang_pred string, score double, hit_share double")


def held_out(doc_id: str = "doc_id"):
    """A third of the documents, by the checksum of their id; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
