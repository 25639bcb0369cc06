"""Text and time Column helpers: stripping, padding, header values, leases."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space (ASCII controls plus Unicode class Zs).
WS_CHARS = "\t\n\x0b\x0c\r   " + "".join(chr(c) for c in range(0x2000, 0x200B)) + "  　"
# The same set as a regex class body, understood by Java and RE2 alike.
WS_CLASS = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
WS = f"[{WS_CLASS}]"
WS_NO_NEWLINE = r"[\t\x0B-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c: Column | str) -> Column:
    """``c`` as the output of a one-element explode.

    The optimizer copies a plain projected expression into every later use of it (filters, fields,
    inferred size checks of explodes). Behind a generator it is computed once per row. For
    expressions that are costly: regexes over whole texts, JSON decoding.
    """
    return F.explode(F.array(col(c)))


def strip_ws(c: Column | str) -> Column:
    """Strip Unicode white space from both ends (plain ``trim`` removes U+0020 only)."""
    return F.trim(col(c), F.lit(WS_CHARS))


def nonblank(c: Column | str) -> Column:
    """The stripped text, or NULL when nothing is left."""
    return F.nullif(strip_ws(c), F.lit(""))


def pad4(c: Column | str) -> Column:
    """Left zero pad to four digits without ever cutting longer numbers (``lpad`` would)."""
    return F.format_string("%04d", col(c).cast("bigint"))


def format_moment(c: Column | str) -> Column:
    return F.date_format(col(c), "yyMMdd_HHmmss")


def as_time(value: Column | str | dt.datetime) -> Column:
    """An explicit point in time; operators never read the clock themselves."""
    if isinstance(value, Column):
        return value
    text = value.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(value, dt.datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def lease_until(as_of: Column | str | dt.datetime, seconds: int) -> Column:
    return as_time(as_of) + F.make_dt_interval(secs=F.lit(seconds))


def lease_free(claimed_until: Column | str, as_of: Column | str | dt.datetime) -> Column:
    """Free when never claimed or when the claim ran out; a claim ending exactly now is still held."""
    c = col(claimed_until)
    return c.isNull() | (c < as_time(as_of))


def rewrite_prompt(number: Column | str, title: Column | str) -> Column:
    return F.concat(
        F.lit("Generate a first version for item "), col(number).cast("string"), F.lit(', "'), col(title), F.lit('"'))


def stable_uuid(*parts: Column | str) -> Column:
    """A UUID-shaped key derived from its inputs, so a re-run of a task gives the same key."""
    h = F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts]))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def is_uuid(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\\z"), F.lit(False))


def json_string(c: Column | str) -> Column:
    """The JSON literal (quotes and escapes included) of a string column."""
    j = F.to_json(F.struct(col(c).alias("v")))
    return F.when(col(c).isNotNull(), F.substr(j, F.lit(6), F.length(j) - 6))


# ---- header values -----------------------------------------------------------------

def unescape(c: Column | str) -> Column:
    """Backslash escapes, replaced one kind after the other: ``\\\\`` first, then tab, newline, quote."""
    out = col(c)
    for seq, char in (("\\\\", "\\"), ("\\t", "\t"), ("\\n", "\n"), ('\\"', '"')):
        out = F.replace(out, F.lit(seq), F.lit(char))
    return out


def _wrapped(c: Column, first: str, last: str) -> Column:
    return (F.length(c) >= 2) & c.startswith(first) & c.endswith(last)


def _inner(c: Column) -> Column:
    return F.substr(c, F.lit(2), F.length(c) - 2)


def _number_json(c: Column) -> Column:
    d = c.try_cast("double")
    exact = F.when(F.abs(d) < 2.0**63, d.try_cast("bigint").cast("string"))  # all digits of the double
    whole = F.coalesce(exact, d.try_cast("decimal(38,0)").cast("string"))
    return F.when((d == F.round(d)) & whole.isNotNull(), whole).otherwise(d.cast("string"))


NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"


def _scalar(c: Column) -> tuple[Column, Column]:
    """(type, JSON text) of a stripped header value that is not an array."""
    vtype = (
        F.when(_wrapped(c, '"', '"'), "string").when(c.isin("true", "false"), "boolean")
        .when(c.rlike(NUMBER), "number").otherwise("string"))
    json = (
        F.when(_wrapped(c, '"', '"'), json_string(unescape(_inner(c)))).when(c.isin("true", "false"), c)
        .when(c.rlike(NUMBER), _number_json(c)).otherwise(json_string(c)))
    return vtype, json


def _element(part: Column) -> Column:
    """JSON text of one array element.

    Commas split before anything else, so a nested array can hold a single element only:
    it is some number of brackets around one scalar, which are counted and peeled off.
    """
    count = lambda s: F.length(F.regexp_replace(s, WS, ""))
    opened = count(F.regexp_extract(part, rf"^[\[{WS_CLASS}]*", 0))
    closed = count(F.regexp_extract(part, rf"[\]{WS_CLASS}]*$", 0))
    depth = F.least(opened, closed)
    before = F.length(F.call_function("substring_index", part, F.lit("["), depth))  # text before the innermost bracket
    after = F.length(F.call_function("substring_index", part, F.lit("]"), -depth))
    core = F.when(depth > 0, strip_ws(F.substr(part, before + 2, F.length(part) - before - after - 2))).otherwise(part)
    return F.concat(F.repeat(F.lit("["), depth), _scalar(core)[1], F.repeat(F.lit("]"), depth))


def _split_outside_quotes(inner: Column) -> Column:
    return F.split(inner, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')


def header_value(c: Column | str, respect_quotes: bool = False) -> Column:
    """``struct(vtype, json)`` of a header value: quoted string, boolean, array, number, else raw text.

    Quotes do not protect commas inside arrays unless ``respect_quotes`` is set.
    """
    v = strip_ws(c)
    inner = strip_ws(_inner(v))
    parts = _split_outside_quotes(inner) if respect_quotes else F.split(inner, ",")
    array = F.concat(F.lit("["), F.array_join(F.transform(parts, lambda p: _element(strip_ws(p))), ","), F.lit("]"))
    is_array = _wrapped(v, "[", "]")
    vtype, json = _scalar(v)
    return F.struct(
        F.when(is_array, "array").otherwise(vtype).alias("vtype"),
        F.when(is_array, array).otherwise(json).alias("json"))
