"""Text normalisation and counting."""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: the characters that count as whitespace when text is stripped or
# split into words (the Unicode whitespace set of the label rules), written as a
# regex class body that both Java regex and RE2 accept.
WS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")

_STRIP_RE = f"^[{WS}]+|[{WS}]+$"
_CLEAN_RE = f"[^a-z0-9{WS}]"
_SPLIT_RE = f"[{WS}]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(c) -> Column:
    """Remove leading and trailing whitespace (all kinds, not only blanks)."""
    return F.regexp_replace(_c(c), _STRIP_RE, "")


def norm(c) -> Column:
    """NULL -> '', strip whitespace, lower case."""
    return F.lower(strip_ws(F.coalesce(_c(c), F.lit(""))))


def clean_text(c) -> Column:
    """Lower case; every character other than a-z, 0-9 and whitespace -> blank."""
    return F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), _CLEAN_RE, " ")


def py_split(c) -> Column:
    """Split on whitespace runs, no empty words (like ``str.split()``)."""
    return F.filter(F.split(_c(c), _SPLIT_RE), lambda w: F.length(w) > 0)


def tag_tokens(c) -> Column:
    """Comma separated tag string -> array of stripped, lower-cased, non-empty tags."""
    parts = F.split(F.coalesce(_c(c), F.lit("")), ",")
    return F.filter(F.transform(parts, lambda t: F.lower(strip_ws(t))),
                    lambda t: F.length(t) > 0)


def count_sub(text, key: str) -> Column:
    """Non-overlapping occurrences of ``key`` in ``text`` (text must be ASCII).

    The ``contains`` guard skips the replace for the common no-hit case; byte
    lengths are exact because cleaned text is pure ASCII.
    """
    t = _c(text)
    n = (F.octet_length(t) - F.octet_length(F.replace(t, F.lit(key), F.lit("")))) / len(key)
    return F.when(t.contains(key), n.cast("long")).otherwise(F.lit(0).cast("long"))


def sql_str(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def count_sub_sql(col: str, key: str) -> str:
    """``count_sub`` as Spark SQL text (one expression per keyword, built in one call)."""
    k = sql_str(key)
    c = f"`{col}`"
    return (f"CASE WHEN contains({c}, {k}) THEN "
            f"(octet_length({c}) - octet_length(replace({c}, {k}, ''))) DIV {len(key)} ELSE 0L END")


_REFERENCE = r"^(#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};?)"
_LEGACY = 6  # longest name that may stand without its semicolon


def unescape_html(c: Column) -> Column:
    """Decode all named and numeric character references, as HTML parsers do.

    The text is split at ``&``; each part's reference is looked up in the standard
    table of names, or computed from its number.  Numbers below 256 go through a
    table too (128-159 mean Windows characters); numbers that are no character
    give U+FFFD.  What is no reference stays as it is.
    """
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    low = F.from_json(F.lit(json.dumps({str(n): html.unescape(f"&#{n};") for n in range(256)})), "map<string,string>")

    def part(p):
        ref = F.regexp_extract(p, _REFERENCE, 1)
        body = F.rtrim(ref, F.lit(";"))
        is_hex = F.lower(F.substr(ref, F.lit(1), F.lit(2))) == "#x"
        number = F.when(is_hex, F.conv(F.substr(body, F.lit(3)), 16, 10)).otherwise(F.substr(body, F.lit(2))).cast("int")
        wrong = (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        char = (F.when(number < 256, F.try_element_at(low, number.cast("string"))).when(wrong, "\ufffd")
                .otherwise(F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")))
        whole = F.when(ref.startswith("#"), char).otherwise(F.try_element_at(table, ref))
        rest = F.substr(p, F.length(ref) + 1)
        out = F.when(whole.isNotNull(), F.concat(whole, rest)).otherwise(F.concat(F.lit("&"), p))
        for n in range(2, _LEGACY + 1):  # a longer name found wins over a shorter one
            name = F.try_element_at(table, F.substr(ref, F.lit(1), F.lit(n)))
            out = F.when(whole.isNull() & (F.length(ref) > n) & name.isNotNull() & ~ref.startswith("#"),
                         F.concat(name, F.substr(p, F.lit(n + 1)))).otherwise(out)
        return out

    parts = F.split(c, "&")
    decoded = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), part), ""))
    return F.when(c.contains("&"), decoded).otherwise(c)
