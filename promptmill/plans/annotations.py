"""Registered queries that hold annotated pages against a reading of their tags as a relation.

The SQL does not walk a page: its tags are rows, the depth of a tag among those of its name is a prefix sum, partners
are the n-th open and the n-th close tag of one depth, and a piece of text is annotated if a paragraph or list
item is open around it and no reference span is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.functions import refs
from promptmill.functions.text import once
from promptmill.operators import pages
from promptmill.plans.inputs import Inputs
from promptmill.plans.registry import query

# comments, raw text elements with their content, tags, declarations
_RAW = r"<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TAGS = rf"""(?is)<!--.*?-->|{_RAW}|</?[a-z][a-z0-9_:-]*(?:"[^"]*"|'[^']*'|[^>"'])*>|<[!?/][^>]*>"""
SPAN = rf'<span class="{refs.REF_CLASS}" data-kind="([^"]*)" data-main="([^"]*)"(?: data-range-end="([^"]*)")?(?: data-alt="([^"]*)")?>'

_lit = lambda s: "'" + s.replace("'", "''") + "'"
_KIND = f"translate(kind, '{refs.HYPHENS}', '{'-' * len(refs.HYPHENS)}')"

_SPANS_SQL = f"""with page as (select page_id, html, [''] || regexp_extract_all(html, {_lit(TAGS)}) as tags, regexp_split_to_array(html, {_lit(TAGS)}) as texts from ref_pages),
    token as (select page_id, unnest(tags) as tag, unnest(texts) as text, unnest(generate_series(1, len(tags))) as i from page),
    named as (select page_id, i, tag, lower(regexp_extract(tag, '^</?([A-Za-z][A-Za-z0-9_:-]*)', 1)) as name, starts_with(tag, '</') as closes from token),
    paired as (select *, case when closes then -1 else 1 end as step from named where name <> '' and not regexp_matches(tag, {_lit(f'(?is)^(?:{_RAW})$')})
      and (closes or (not regexp_matches(tag, '/>$') and name not in ({', '.join(_lit(n) for n in sorted(pages.VOID_ELEMENTS))})))),
    summed as (select *, sum(step) over (partition by page_id, name order by i) as s from paired),
    lowest as (select *, least(0, min(s) over (partition by page_id, name order by i)) as low, least(0, coalesce(min(s) over (partition by page_id, name order by i rows between unbounded preceding and 1 preceding), 0)) as before from summed),
    levels as (select *, case when closes then s - low + 1 else s - low end as level from lowest where not closes or low = before),
    placed as (select *, row_number() over (partition by page_id, name, level, closes order by i) as n from levels),
    element as (select o.page_id, o.name, o.tag, o.i as first, coalesce(c.i, 1000000000) as past from placed o left join placed c
      on c.page_id = o.page_id and c.name = o.name and c.level = o.level and c.n = o.n and c.closes where not o.closes),
    inside as (select page_id, i, text from token t where exists (select 1 from element e where e.page_id = t.page_id and e.name in ('p', 'li') and e.first <= t.i and t.i < e.past)
      and not exists (select 1 from element e where e.page_id = t.page_id and e.name = 'span' and e.first <= t.i and t.i < e.past
        and list_contains(regexp_split_to_array(lower(regexp_extract(e.tag, '(?i)\\sclass\\s*=\\s*"([^"]*)"', 1)), '\\s+'), '{refs.REF_CLASS}'))),
    found as (select page_id, i, {', '.join(f"regexp_extract_all(text, '{refs.REF_PATTERN}', {g}) as g{g}" for g in range(1, 5))} from inside),
    ref as (select page_id, i, unnest(g1) as kind, unnest(g2) as main, unnest(g3) as range_end, unnest(g4) as alt, unnest(generate_series(1, len(g1))) as k from found),
    listed as (select page_id, count(*) as n_spans, string_agg({_KIND} || '|' || main || '|' || coalesce(range_end, '') || '|' || coalesce(alt, ''), ',' order by i, k) as spans from ref group by page_id)
    select page_id, coalesce(n_spans, 0) as n_spans, coalesce(spans, '') as spans, sha256(array_to_string(texts, '')) as text_digest
    from page left join listed using (page_id)"""


def _spans(annotated: DataFrame) -> DataFrame:
    """Per page its reference spans in order, and a digest of its text without tags."""
    part = lambda g: F.regexp_extract_all("html", F.lit(SPAN), F.lit(g)).alias(f"g{g}")
    joined = F.transform(F.col("_s"), lambda s: F.concat_ws("|", *[s[f"g{g}"] for g in range(1, 5)]))
    digest: Column = F.sha2(F.regexp_replace("html", TAGS, "").cast("binary"), 256)
    return annotated.select("page_id", once(F.arrays_zip(*map(part, range(1, 5)))).alias("_s"), digest.alias("text_digest")).select(
        "page_id", F.coalesce(F.size("_s"), F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce(F.array_join(joined, ","), F.lit("")).alias("spans"), "text_digest")


@query(_SPANS_SQL, "ref_pages")
def annotated_spans(t: Inputs) -> DataFrame:
    """What ``annotate_refs`` put into every page."""
    return _spans(pages.annotate_refs(t.ref_pages.select("page_id", "html")))


@query(_SPANS_SQL, "ref_pages")
def annotated_page_spans(t: Inputs) -> DataFrame:
    """The same after the whole page pass: assets and classes leave spans and text as they are."""
    return _spans(pages.annotated_pages(t.ref_pages.select("page_id", "html")))


@query(f"""with g as (select page_id, unnest(regexp_extract_all(html, '(?i)<(?:ul|span)\\s+class="([^"]*)"', 1)) as class from ref_pages)
    select page_id, count(*) filter (list_contains(regexp_split_to_array(lower(class), '\\s+'), '{refs.REF_CLASS}')) as n_refs,
      count(*) filter (list_contains(regexp_split_to_array(lower(class), '\\s+'), 'nav')) as n_nav from g group by page_id""", "ref_pages")
def has_class(t: Inputs) -> DataFrame:
    """Open ``ul`` and ``span`` tags of every page by class."""
    tags = t.ref_pages.select("page_id", once(refs.open_tags(F.col("html"))).alias("_t")).select("page_id", F.inline("_t"))
    classed = tags.where(F.col("tag").isin("ul", "span") & F.col("class").isNotNull())
    return classed.groupBy("page_id").agg(
        F.count_if(refs.has_class(F.col("class"), refs.REF_CLASS)).alias("n_refs"), F.count_if(refs.has_class(F.col("class"), "nav")).alias("n_nav"))
