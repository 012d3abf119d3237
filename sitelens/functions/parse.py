"""Decoding of JSON text, timestamps, colours and icon keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.dictionaries import DEFAULT, DEFAULT_ICON, Dictionaries
from sitelens.functions.text import strip_ws

COLORS_TYPE = "struct<primary:string,secondary:string>"
SIGNALS_TYPE = ("struct<platform_scores:map<string,double>,"
                "industry_scores:map<string,double>,"
                "colors:struct<primary:string,secondary:string>>")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_hex(c) -> Column:
    """'#abc' -> '#aabbcc'; 6 or more digits -> first 6, lower case; else unchanged."""
    s = _c(c)
    h = F.regexp_replace(s, "^#+", "")
    doubled = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return F.when(F.length(doubled) >= 6,
                  F.concat(F.lit("#"), F.lower(F.substring(doubled, 1, 6)))).otherwise(s)


def icon_key(platform, dicts: Dictionaries = DEFAULT) -> Column:
    """Icon key of a platform label (trimmed, lower-cased); unknown -> default."""
    key = F.lower(strip_ws(F.coalesce(_c(platform), F.lit(""))))
    key = F.when(F.length(key) == 0, F.lit("unknown")).otherwise(key)
    pairs = []
    for k, v in dicts.icons:
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(DEFAULT_ICON))


EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from a datetime or ISO text, without passing through
    the session or process time zone (a Python datetime literal would)."""
    if value is None:
        return F.lit(None).cast("timestamp_ntz")
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if hasattr(value, "isoformat") else str(value)
    return F.lit(text).cast("timestamp_ntz")


def as_of_col(as_of) -> Column:
    """The evaluation time of an operator: ``as_of`` if given, else the current
    local time without zone."""
    return F.localtimestamp() if as_of is None else ntz_lit(as_of)
# an offset counts only right after a time of day (so '2024-01-05' has none)
_OFFSET_RE = r"[0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?\s*(Z|z|[+-][0-9]{2}(:?[0-9]{2})?)$"


def utc_wall_clock(instant: Column) -> Column:
    """An instant (TIMESTAMP) as its UTC wall-clock time (TIMESTAMP_NTZ), by epoch
    arithmetic -- independent of the session time zone and of DST."""
    secs = (F.unix_micros(instant) / F.lit(1_000_000)).cast("decimal(18,6)")
    return (F.lit(EPOCH_NTZ).cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs))


def epoch_micros(ts: Column, is_ntz: bool) -> Column:
    """Microseconds since the epoch; NTZ values count as UTC wall clock."""
    if is_ntz:
        return F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), ts)
    return F.unix_micros(ts)


def parse_ts(c) -> Column:
    """ISO-8601 text -> UTC timestamp without zone; invalid -> NULL.

    With an explicit offset ('Z', '+02:00') the text is an instant and becomes
    its UTC wall clock; without one, the wall clock is kept as written.  The
    result never depends on the session time zone.
    """
    s = strip_ws(_c(c))
    with_zone = F.regexp_like(s, F.lit(_OFFSET_RE))
    return F.when(with_zone, utc_wall_clock(F.try_to_timestamp(s))) \
        .otherwise(s.try_cast("timestamp_ntz"))


def _blank(c: Column) -> Column:
    return c.isNull() | (F.length(strip_ws(c)) == 0)


def decode_json_array(c) -> Column:
    """JSON list of strings -> array; blank, invalid or empty -> NULL."""
    s = _c(c)
    arr = F.from_json(s, "array<string>")
    return F.when(~_blank(s) & (F.size(arr) > 0), arr)


def decode_json_map(c, value_type: str = "double") -> Column:
    """JSON object -> map; blank, invalid or empty -> NULL."""
    s = _c(c)
    m = F.from_json(s, f"map<string,{value_type}>")
    return F.when(~_blank(s) & (F.size(m) > 0), m)


def decode_json_struct(c, ddl: str) -> Column:
    """JSON object -> struct of the given type; blank or invalid -> NULL."""
    s = _c(c)
    return F.when(~_blank(s), F.from_json(s, ddl))
