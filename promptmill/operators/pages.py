"""HTML pages: reference annotation, tag classes, text audits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptmill.functions import refs
from promptmill.functions.text import once
from promptmill.session import bound_batches, ship_package

# Elements without content, and elements holding raw text.
VOID_ELEMENTS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TEXT_ELEMENTS = ("script", "style")
ANNOTATED_ELEMENTS = ("p", "li")

_TOKEN = re.compile(
    r"<!--.*?-->|<(?P<raw>script|style)\b.*?</(?P=raw)\s*>|<(?P<close>/?)(?P<name>[A-Za-z][\w:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>",
    re.S | re.I)
_CLASS = re.compile(r"""\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_REF = re.compile(refs.REF_PATTERN)
_FOLD = str.maketrans(refs.HYPHENS, "-" * len(refs.HYPHENS))


def _span(m: re.Match) -> str:
    extra = "".join(f' {k}="{v}"' for k, v in (("data-range-end", m[3]), ("data-alt", m[4])) if v)
    return f'<span class="{refs.REF_CLASS}" data-kind="{m[1].translate(_FOLD)}" data-main="{m[2]}"{extra}>{m[0]}</span>'


def _is_ref_span(name: str, attrs: str) -> bool:
    found = _CLASS.search(attrs) if name == "span" else None
    return bool(found) and refs.REF_CLASS in next(g for g in found.groups() if g is not None).lower().split()


def _partners(tags: list[tuple[int, str, bool]]) -> dict[int, int]:
    """Position of each open tag -> position of the close tag that balances it, per element name."""
    waiting: dict[str, list[int]] = {}
    pairs: dict[int, int] = {}
    for at, name, closes in tags:
        if not closes:
            waiting.setdefault(name, []).append(at)
        elif waiting.get(name):
            pairs[waiting[name].pop()] = at
    return pairs


def annotate_html(html: str) -> str:
    """Wrap references in spans inside ``p`` and ``li`` elements, however deep.

    References in an existing reference span stay as they are. An element left open takes the
    rest of its surrounding element and gets its close tag there.
    """
    tokens = list(_TOKEN.finditer(html))
    opens = lambda m: m["name"] and not m["close"] and not m["attrs"].endswith("/") and m["name"].lower() not in VOID_ELEMENTS
    pairs = _partners([(m.start(), m["name"].lower(), bool(m["close"])) for m in tokens if m["close"] or opens(m)])
    out: list[str] = []
    ranges: list[tuple[int, str, bool]] = []  # open elements: end position, name to close it with, untouched?
    pos = 0

    def text(upto: int) -> None:
        piece = html[pos:upto]
        out.append(_REF.sub(_span, piece) if ranges and not ranges[-1][2] else piece)

    for m in tokens:
        text(m.start())
        pos = m.end()
        while ranges and ranges[-1][0] <= m.start():
            out.append(ranges.pop()[1])
        out.append(m[0])
        name = (m["name"] or "").lower()
        if m["close"] or not opens(m) or (ranges and ranges[-1][2]) or not (ranges or name in ANNOTATED_ELEMENTS):
            continue
        limit = ranges[-1][0] if ranges else len(html)
        end = pairs.get(m.start(), len(html))
        closed = end < limit
        ranges.append((end if closed else limit, "" if closed else f"</{m['name']}>", _is_ref_span(name, m["attrs"])))
    text(len(html))
    while ranges:
        out.append(ranges.pop()[1])
    return "".join(out)


def _merged(old: str, new: str) -> str:
    kept: dict[str, str] = {}
    for token in old.split() + new.split():
        kept.setdefault(token.lower(), token)
    return " ".join(kept.values())


def classed_html(html: str) -> str:
    """Merge the standing class lists into the open tags that have one."""
    def tag(m: re.Match) -> str:
        new = refs.TAG_CLASSES.get((m["name"] or "").lower())
        if new is None or m["close"]:
            return m[0]
        found = _CLASS.search(m["attrs"])
        old = next(g for g in found.groups() if g is not None) if found else ""
        attr = f' class="{_merged(old, new)}"'
        attrs = m["attrs"][:found.start()] + attr + m["attrs"][found.end():] if found else m["attrs"]
        if found:
            return f"<{m['name']}{attrs}>"
        slash = "/" if attrs.endswith("/") else ""
        return f"<{m['name']}{attrs[:-1] if slash else attrs}{attr}{slash}>"

    return _TOKEN.sub(tag, html)


def _map_pages(df: DataFrame, column: str, *steps) -> DataFrame:
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)  # whole pages: a batch by its bytes, not by its rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for step in steps:
                pdf[column] = pdf[column].map(step, na_action="ignore")
            yield pdf

    return df.mapInPandas(run, T.StructType(df.schema.fields))


def annotate_refs(pages: DataFrame, html: str = "html") -> DataFrame:
    """Annotated pages. Arrow batches in, Arrow batches out, no shuffle."""
    return _map_pages(pages, html, annotate_html)


def annotated_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """The whole page pass: head assets, references, tag classes."""
    return _map_pages(pages.withColumn(html, refs.insert_head_assets(F.col(html))), html, annotate_html, classed_html)


def tag_inventory(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Open tags with a standing class list: per page, tag and old class the merged class and a count."""
    rules = F.create_map(*[x for t, c in refs.TAG_CLASSES.items() for x in (F.lit(t), F.lit(c))])
    tags = pages.select(key, once(refs.open_tags(F.col(html))).alias("_t")).select(key, F.inline("_t")).where(F.col("tag").isin(*refs.TAG_CLASSES))
    counted = tags.groupBy(key, "tag", "class").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("merged_class", refs.merge_class(F.col("class"), F.element_at(rules, F.col("tag"))))


def deliverable_refs(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """References in order of occurrence: (key, pos, kind, main, range_end, alt, raw)."""
    found = texts.select(key, once(refs.references(F.col(text))).alias("_r")).select(key, F.posexplode("_r").alias("pos", "raw"))
    return found.select(key, (F.col("pos") + 1).cast("bigint").alias("pos"), refs.reference_parts(F.col("raw")).alias("_p"), "raw").select(
        key, "pos", "_p.kind", "_p.main", "_p.range_end", "_p.alt", "raw")


def ref_summary(texts: DataFrame, text: str = "text") -> DataFrame:
    """References and documents per kind, from one row per document.

    Kinds are counted inside the row, so the shuffle carries at most one partial row per kind and
    task, and no distinct count over documents is needed.
    """
    kinds = F.transform(refs.references(F.col(text)), refs.reference_kind)
    per_doc = texts.select(once(kinds).alias("_k")).select("_k", F.explode(F.array_distinct("_k")).alias("kind"))
    n = F.size(F.filter(F.col("_k"), lambda k: k == F.col("kind")))
    return per_doc.groupBy("kind").agg(F.sum(n).cast("bigint").alias("n_refs"), F.count(F.lit(1)).alias("n_docs"))


def uncovered_characters(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Occurrences per document of the characters that need a font mapping."""
    counts = F.array(*[
        F.struct(F.lit(f"U+{cp:04X}").alias("code_point"), refs.character_count(F.col(text), chr(cp)).alias("n"))
        for cp in refs.UNCOVERED_CODE_POINTS])
    return texts.select(key, F.inline(counts)).where(F.col("n") > 0)


def math_spans(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Math spans ``$..$`` and whether each is really a regular expression."""
    spans = F.regexp_extract_all(F.col(text), F.lit(r"\$([^$\n]+)\$"), F.lit(1))
    return texts.select(key, once(spans).alias("_s")).select(key, F.posexplode("_s").alias("pos", "span")).select(
        key, (F.col("pos") + 1).cast("bigint").alias("pos"), "span", refs.looks_regex_like(F.col("span")).alias("is_regex"))
