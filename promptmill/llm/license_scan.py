"""License scan with a positional index of rare words, in DataFrame operations only.

Each licence template has mandatory key phrases; the index holds, for each template, the places
of the words of its key phrases that are rarest in the documents at hand (highest IDF). Of a
document only licence words with their positions are kept. Words that are in the index are looked
up, the postings of a template are intersected by relative position (document place minus
template place), and an alignment that all its indexed words agree on is verified: every key
phrase must stand there word by word, and enough of the template around it.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.session import cut_lineage

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COVERAGE = 0.6  # least share of a template's words at their places
RARE_WORDS = 3  # indexed words of a template

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key_phrases: tuple[str, ...]  # each a run of words of the text


#: Notices of common licences, as lower-case words, with the phrases that must be there.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
             ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
             ("terms of the gnu general public license", "published by the free software foundation")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
             ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
)


def _words(text: str) -> list[str]:
    return text.split()


def _place(words: Sequence[str], phrase: Sequence[str]) -> int:
    return next(i for i in range(len(words)) if list(words[i: i + len(phrase)]) == list(phrase))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: Sequence[Template] = TEMPLATES,
         coverage: float = COVERAGE) -> DataFrame:
    """One row per row of ``docs``: (id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Words are what ``SEPARATORS`` leave of the text, A-Z lower-cased; a null text has none.
    ``n_base`` counts the places of ``phrases``, ``first_word`` and ``last_word`` are the first and
    last of them (null without one). ``labels`` adds those of verified templates. ``score`` is the
    greatest share of a verified template that is there, at least 0.5 where a phrase is, else 0.
    """
    vocabulary = sorted({w for p in phrases for w in _words(p)} | {w for t in templates for w in _words(t.text)})
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    plain = F.split(lowered, SEPARATORS)
    source = docs.select(F.col(id).alias("id"), plain.alias("w"))
    lead = (F.element_at("w", 1) == "").cast("int")
    tail = F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    hits = F.array_compact(F.transform("w", lambda x, i: F.when(x.isin(vocabulary), F.struct(x.alias("w"), (i - F.col("lead")).cast("int").alias("p")))))
    kept = cut_lineage(
        source.withColumn("lead", lead).select(
            F.monotonically_increasing_id().alias("row"), "id", (F.size("w") - F.col("lead") - tail).cast("bigint").alias("n_words"), hits.alias("hits")), "licence-words")

    # the index: the rarest words of each template's key phrases, by the documents' own counts (at most a row per licence word)
    seen = {r["w"]: r["n"] for r in kept.select(F.explode(F.array_distinct(F.col("hits.w"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    postings = []
    for t, template in enumerate(templates):
        words = _words(template.text)
        places = {_place(words, _words(p)) + i: w for p in template.key_phrases for i, w in enumerate(_words(p))}
        rare = sorted(places, key=lambda i: (seen.get(places[i], 0), i))[:RARE_WORDS]
        postings += [(places[i], t, i, len(rare)) for i in rare]
    index = docs.sparkSession.createDataFrame(postings, "w string, template int, place int, wanted int")

    rare_words = sorted({p[0] for p in postings})
    looked = kept.where(F.arrays_overlap(F.col("hits.w"), _strings(rare_words))).select(
        "row", F.explode(F.filter(F.transform("hits", lambda h, i: F.struct(h["w"], h["p"], i.alias("i"))), lambda h: h["w"].isin(rare_words))).alias("h")).select(
        "row", F.col("h.w").alias("w"), F.col("h.p").alias("p"), F.col("h.i").alias("i"))
    # the index has a few rows per template of a fixed library
    aligned = looked.join(F.broadcast(index), "w").groupBy("row", "template", (F.col("p") - F.col("place")).alias("at")).agg(
        F.count(F.lit(1)).alias("n"), F.first("wanted").alias("wanted"), F.min("i").alias("i")).where("n = wanted")
    tried = aligned.groupBy("row").agg(F.collect_set(F.struct("template", "at", "i")).alias("tried"))

    judged = kept.join(tried, "row", "left")
    cases = [_verify(t, template, coverage) for t, template in enumerate(templates)]
    found = F.filter(F.transform(F.coalesce("tried", F.array().cast("array<struct<template:int,at:int,i:int>>")), lambda c: F.coalesce(*[case(c) for case in cases])), lambda x: x.isNotNull())
    base = F.flatten(F.array(*[_labelled(_starts(_words(p)), label) for p, label in phrases.items()]))
    out = judged.select("id", "n_words", base.alias("base"), found.alias("found"))
    has = F.size("base") > 0
    return out.select(
        F.col("id").alias(id), "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.p").cast("bigint").alias("first_word"), F.array_max("base.p").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base.label", "found.label"))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max("found.share"), F.lit(0.0)), F.when(has, 0.5).otherwise(0.0)).alias("score"))


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda h: F.struct(h["p"].alias("p"), F.lit(label).alias("label")))


def _starts(words: list[str]) -> Column:
    """Hits at which the words stand one behind the other; such words are neighbours among the hits, too."""
    def begins(h: Column, i: Column) -> Column:
        fits = h["w"] == words[0]
        for k, w in enumerate(words[1:], 1):
            other = F.get(F.col("hits"), i + k)
            fits = fits & (other["w"] == w) & (other["p"] == h["p"] + k)
        return F.coalesce(fits, F.lit(False))

    return F.filter("hits", begins)


def _verify(number: int, template: Template, coverage: float):
    """Label and share of a template at an alignment, or null."""
    words = _words(template.text)

    def at(c: Column, places: Sequence[int]) -> Column:
        return F.array(*[F.struct(F.lit(words[i]).alias("w"), (c["at"] + i).cast("int").alias("p")) for i in places])

    mandatory = sorted({_place(words, _words(p)) + i for p in template.key_phrases for i in range(len(_words(p)))})

    def case(c: Column) -> Column:
        # all hits within the template's length of the aligned one, however long the text is
        near = F.slice("hits", F.greatest(c["i"] + 1 - len(words), F.lit(1)), F.lit(2 * len(words)))
        share = F.size(F.array_intersect(at(c, range(len(words))), near)) / len(words)
        there = F.size(F.array_except(at(c, mandatory), near)) == 0
        return F.when((c["template"] == number) & there & (share >= coverage), F.struct(F.lit(template.label).alias("label"), share.alias("share")))

    return case


def twin(table: str = "documents", phrases: dict[str, str] = PHRASES, templates: Sequence[Template] = TEMPLATES, coverage: float = COVERAGE) -> str:
    """The same result as DuckDB SQL without an index: every phrase and template is tried at every word."""
    def listed(words: Sequence[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    def places(words: Sequence[str]) -> str:
        return f"list_filter(range(len(w)), lambda i: w[i + 1:i + {len(words)}] = {listed(words)})"

    base = ", ".join(f"list_transform({places(_words(p))}, lambda i: {{'p': i, 'label': '{label}'}})" for p, label in phrases.items())
    parts = []
    for t in templates:
        words = _words(t.text)
        keys = [(_place(words, _words(p)), _words(p)) for p in t.key_phrases]
        k0, first = keys[0]
        more = "".join(f" and w[i + {k - k0} + 1:i + {k - k0} + {len(p)}] = {listed(p)} and i + {k - k0} >= 0" for k, p in keys[1:])
        share = f"len(list_filter(range({len(words)}), lambda j: i - {k0} + j >= 0 and w[i - {k0} + j + 1] = {listed(words)}[j + 1])) / {float(len(words))}"
        parts.append(f"list_filter(list_transform(list_filter({places(first)}, lambda i: true{more}), lambda i: {{'label': '{t.label}', 'share': {share}}}), lambda x: x.share >= {coverage})")
    return f"""
    with s as (
      select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from {table}),
    f as (select doc_id, len(w) as n_words, flatten([{base}]) as base, flatten([{', '.join(parts)}]) as found from s)
    select doc_id, n_words, len(base) as n_base, list_min(list_transform(base, lambda b: b.p)) as first_word, list_max(list_transform(base, lambda b: b.p)) as last_word,
      array_to_string(list_sort(list_distinct(list_transform(base, lambda b: b.label))), ',') as base_labels,
      array_to_string(list_sort(list_distinct(list_concat(list_transform(base, lambda b: b.label), list_transform(found, lambda x: x.label)))), ',') as labels,
      greatest(coalesce(list_max(list_transform(found, lambda x: x.share)), 0.0), case when len(base) > 0 then 0.5 else 0.0 end)::double as score
    from f"""
