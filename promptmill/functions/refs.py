"""Deliverable references, class lists and head assets in text and HTML columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------
HYPHENS = "‐‑‒–—"
REF_KINDS = ("SEC-MKT", "GOV", "SEC", "OFF", "TAX", "TOK", "PAY", "VND", "POL", "DOC", "OPN", "INT", "PLY")
HEAD_ASSETS = (
    '<script src="https://cdn.tailwindcss.com"></script>'
    '<link rel="stylesheet" href="draftDlv_1.css"></link>'
)
TAG_CLASSES = {
    "ol": "list-decimal list-outside ml-8 my-6 space-y-1",
    "ul": "list-disc list-outside ml-8 my-6 space-y-1",
    "li": "my-1",
    "p": "my-3 text-justify",
    "h1": "text-2xl font-bold leading-tight mt-8 mb-3",
    "h2": "text-xl font-bold leading-tight mt-8 mb-3",
    "h3": "text-lg font-semibold leading-snug mt-6 mb-2",
    "blockquote": "border-l-4 pl-4 text-gray-600 italic my-4",
    "table": "w-full border-collapse my-4",
    "th": "border px-2 py-1 font-semibold bg-gray-50 align-top",
    "td": "border px-2 py-1 align-top",
    "hr": "my-8 border-t",
}
REF_CLASS = "dlv-ref"
# Code points the document fonts need a mapping for.
UNCOVERED_CODE_POINTS = (
    0x2080, 0x2081, 0x2082, 0x2083, 0x2084, 0x2085, 0x2086, 0x2087, 0x2088, 0x2089,
    0x2154, 0x2194, 0x21C4, 0x21D2, 0x2208, 0x2227, 0x25CF, 0x2610, 0x2713,
)
# Markers telling that a math span is really a regular expression.
REGEX_MARKERS = ("\\d{", "\\(", "\\)", "GF-NOTE-", "DMCC-GF-")
REGEX_ANCHOR = "^"
# -----------------------------------------------------------------------------------

_DASH = f"[-{HYPHENS}]"
_KIND = "|".join(k.replace("-", _DASH) for k in REF_KINDS)
REF_PATTERN = rf"({_KIND}){_DASH}([0-9]{{2}})(?:\.\.([0-9]{{2}}))?(?:/([0-9]{{2}}))?"
HEAD_PATTERN = r"(?i)<head(?:\s[^>]*)?>"
OPEN_TAG_PATTERN = r"<([A-Za-z][A-Za-z0-9]*)((?:\s[^>]*)?)>"


def fold_hyphens(c: Column) -> Column:
    """Hyphen-like characters to ``-``; the length never changes."""
    return F.translate(c, HYPHENS, "-" * len(HYPHENS))


# First letters of all kinds, looked at before the alternatives are tried.
_SCAN_PATTERN = f"(?=[{''.join(sorted({k[0] for k in REF_KINDS}))}])" + REF_PATTERN


def references(c: Column) -> Column:
    """All references of a text, left to right, as they stand there: ``array<string>``.

    One regex walks the text once. No word boundaries are needed on either side.
    """
    return F.regexp_extract_all(c, F.lit(_SCAN_PATTERN), F.lit(0))


def reference_kind(raw: Column) -> Column:
    return F.regexp_extract(fold_hyphens(raw), r"^(.*?)-[0-9]", 1)


def reference_parts(raw: Column) -> Column:
    """``struct<kind, main, range_end, alt>`` of one reference (short text, so a few regexes cost little)."""
    part = lambda i: F.nullif(F.regexp_extract(raw, REF_PATTERN, i), F.lit(""))
    return F.struct(
        reference_kind(raw).alias("kind"), part(2).alias("main"), part(3).alias("range_end"), part(4).alias("alt"))


def class_tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def merge_class(old: Column, new: Column) -> Column:
    """Old tokens then new ones, case-insensitive duplicates dropped, first spelling and order kept."""
    tokens = F.concat(class_tokens(F.coalesce(old, F.lit(""))), class_tokens(new))
    kept = F.aggregate(
        tokens, F.array().cast("array<string>"),
        lambda acc, t: F.when(F.exists(acc, lambda k: F.lower(k) == F.lower(t)), acc).otherwise(F.array_append(acc, t)))
    return F.array_join(kept, " ")


def has_class(classes: Column, name: str) -> Column:
    return F.coalesce(F.exists(class_tokens(classes), lambda t: F.lower(t) == name.lower()), F.lit(False))


def insert_head_assets(html: Column, assets: str = HEAD_ASSETS) -> Column:
    """Put ``assets`` right behind the first head tag; pages without one stay as they are."""
    tag = F.regexp_substr(html, F.lit(HEAD_PATTERN))
    end = F.regexp_instr(html, F.lit(HEAD_PATTERN)) + F.length(tag)
    return F.when(tag.isNull(), html).otherwise(
        F.concat(F.substr(html, F.lit(1), end - 1), F.lit(assets), F.substr(html, end)))


def open_tags(html: Column) -> Column:
    """Open tags as ``array<struct<tag, class>>``; ``class`` is NULL without such an attribute."""
    pattern = F.lit(OPEN_TAG_PATTERN)
    zipped = F.arrays_zip(
        F.regexp_extract_all(html, pattern, F.lit(1)).alias("tag"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("attrs"))
    quoted = r'(?i)\sclass\s*=\s*"([^"]*)"'
    return F.transform(zipped, lambda r: F.struct(
        F.lower(r["tag"]).alias("tag"),
        F.when(r["attrs"].rlike(quoted), F.regexp_extract(r["attrs"], quoted, 1)).alias("class")))


def looks_regex_like(c: Column) -> Column:
    hit = c.startswith(REGEX_ANCHOR)
    for marker in REGEX_MARKERS:
        hit = hit | c.contains(marker)
    return hit


def character_count(c: Column, char: str) -> Column:
    """Occurrences of one character, by plain byte search."""
    return (F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))).cast("bigint")
