"""Request templates as Spark expressions.

A template is text with ``{{ path }}`` placeholders, ``{% if condition %}..{% elif condition %}..{% else %}..{% endif %}``
and ``{% for name in path %}..{% endfor %}`` blocks. A condition is made of paths, quoted strings,
numbers, ``true``, ``false``, ``==``, ``!=``, ``not``, ``and``, ``or`` and parentheses. ``to_column`` turns a
template, once and on the driver, into a single string Column, so rendering runs inside the JVM
for every row. Unknown names render as empty text; whatever else a tag holds is a ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN = re.compile(r"\{\{|\{%|\{#")
_TAG = re.compile(r"\{\{\s*(?P<var>[\w.]+)\s*\}\}|\{%\s*(?P<word>\w+)(?P<rest>(?:[^%]|%(?!\}))*)%\}")
_FOR = re.compile(r"^(\w+)\s+in\s+([\w.]+)$")
_TOKEN = re.compile(r"""\s*(?:(?P<op>==|!=|\(|\))|(?P<text>"[^"]*"|'[^']*')|(?P<number>-?[0-9]+(?:\.[0-9]+)?)(?![\w.])|(?P<name>[A-Za-z_][\w.]*))""")


class Value(NamedTuple):
    """What a name stands for: its text, its truth, and for JSON values the variant itself."""

    text: Column
    truth: Column
    variant: Column | None = None


Lookup = Callable[[str], Value]


def plain_value(c: Column) -> Value:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return Value(text, text != "")


def json_value(v: Column) -> Value:
    """Empty strings, zero, false, null and empty collections are false."""
    text = F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
    empty = F.when(F.schema_of_variant(v) == "STRING", text == "").otherwise(text.isin("", "false", "0", "[]", "{}"))
    return Value(text, ~empty, v)


def item_context(production: Column, index: Column, body: Column, meta_json: Column, header: Column) -> Lookup:
    """Names a request template can use: production.name, index, text, meta.*, header_toml, item.*"""
    meta = F.try_parse_json(meta_json)
    plain = {
        "production.name": production, "index": index, "text": body, "header_toml": header,
        "item.index": index, "item.content": body, "item.header_toml": header}

    def look(path: str) -> Value:
        if path in plain:
            return plain_value(plain[path])
        names = path.removeprefix("item.").split(".")
        if names[0] != "meta":
            return plain_value(F.lit(""))
        return json_value(F.try_variant_get(meta, ".".join(["$", *names[1:]]), "variant"))

    return look


def to_column(template: str, look: Lookup) -> Column:
    """One string Column for the whole template."""
    column, _, end = _block(template, 0, look, ())
    if end:
        raise ValueError(f"'{end}' without an opening tag")
    return column


def _block(template: str, pos: int, look: Lookup, stops: tuple[str, ...]) -> tuple[Column, int, str]:
    """Column for the text up to one of the ``stops``, where it ends, and the stop found (with its condition)."""
    parts: list[Column] = [F.lit("")]
    while opening := _OPEN.search(template, pos):
        tag = _TAG.match(template, opening.start())
        if not tag:
            raise ValueError(f"unreadable tag: {template[opening.start(): opening.start() + 40]!r}")
        parts.append(F.lit(template[pos:tag.start()]))
        pos, word, rest = tag.end(), tag["word"], (tag["rest"] or "").strip()
        if tag["var"]:
            parts.append(look(tag["var"]).text)
            continue
        if word in ("else", "endif", "endfor") and rest:
            raise ValueError(f"unreadable tag: {word} {rest}")
        if word in stops:
            return F.concat(*parts), pos, f"{word} {rest}".strip()
        if word == "if":
            column, pos = _choice(template, pos, look, rest)
        elif word == "for":
            column, pos = _loop(template, pos, look, rest)
        else:
            raise ValueError(f"unknown block tag: {word}")
        parts.append(column)
    if stops:
        raise ValueError(f"missing tag, one of {stops}")
    return F.concat(*parts, F.lit(template[pos:])), len(template), ""


def _choice(template: str, pos: int, look: Lookup, rest: str) -> tuple[Column, int]:
    truth = condition(rest, look)
    yes, pos, stop = _block(template, pos, look, ("elif", "else", "endif"))
    no: Column = F.lit("")
    if stop.startswith("elif"):
        no, pos = _choice(template, pos, look, stop.removeprefix("elif").strip())
    elif stop == "else":
        no, pos, _ = _block(template, pos, look, ("endif",))
    return F.when(truth, yes).otherwise(no), pos


class _Operand(NamedTuple):
    text: Column
    truth: Column
    number: Column | None = None


def condition(source: str, look: Lookup) -> Column:
    """Truth of a condition; numbers compare as numbers, everything else as text."""
    tokens: list[tuple[str, str]] = []
    pos = 0
    while pos < len(source.rstrip()):
        m = _TOKEN.match(source, pos)
        if not m:
            raise ValueError(f"unreadable condition: {source!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        pos = m.end()
    tokens.reverse()

    def ahead(*values: str) -> bool:
        return bool(tokens) and tokens[-1][0] in ("op", "name") and tokens[-1][1] in values

    def either() -> Column:
        left = both()
        while ahead("or"):
            tokens.pop()
            left = left | both()
        return left

    def both() -> Column:
        left = negated()
        while ahead("and"):
            tokens.pop()
            left = left & negated()
        return left

    def negated() -> Column:
        if ahead("not"):
            tokens.pop()
            return ~negated()
        if ahead("("):
            tokens.pop()
            inner = either()
            if not ahead(")"):
                raise ValueError(f"missing parenthesis: {source!r}")
            tokens.pop()
            return inner
        left = operand()
        if not ahead("==", "!="):
            return left.truth
        word, right = tokens.pop()[1], operand()
        if left.number is not None or right.number is not None:
            a, b = (x.text.try_cast("double") if x.number is None else x.number for x in (left, right))
            same = F.coalesce(a == b, F.lit(False))
        else:
            same = left.text == right.text
        return same if word == "==" else ~same

    def operand() -> _Operand:
        kind, value = tokens.pop() if tokens else ("end", "")
        if kind == "text":
            return _Operand(F.lit(value[1:-1]), F.lit(len(value) > 2))
        if kind == "number":
            return _Operand(F.lit(value), F.lit(float(value) != 0), F.lit(float(value)))
        if kind == "name" and value in ("true", "false"):
            return _Operand(F.lit(value), F.lit(value == "true"))
        if kind == "name" and value not in ("and", "or", "not", "in", "is"):
            found = look(value)
            return _Operand(found.text, F.coalesce(found.truth, F.lit(False)))
        raise ValueError(f"unreadable condition: {source!r}")

    result = either()
    if tokens:
        raise ValueError(f"unreadable condition: {source!r}")
    return result


def _loop(template: str, pos: int, look: Lookup, rest: str) -> tuple[Column, int]:
    head = _FOR.match(rest)
    over = look(head[2]).variant if head else None
    if over is None:
        raise ValueError(f"unreadable loop: {rest!r}")
    end = pos

    def member_text(member: Column) -> Column:
        nonlocal end

        def inside(path: str) -> Value:
            first, _, rest = path.partition(".")
            if first != head[1]:
                return look(path)
            return json_value(F.try_variant_get(member, f"$.{rest}", "variant") if rest else member)

        column, end, _ = _block(template, pos, inside, ("endfor",))
        return column

    members = F.transform(F.try_variant_get(over, "$", "array<variant>"), member_text)
    return F.coalesce(F.array_join(members, ""), F.lit("")), end
