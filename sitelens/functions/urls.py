"""URL handling: validation, normalisation, host/path split, percent-encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.text import norm, strip_ws

# FIXED VALUES: validation messages and limits of the catalog's write path.
MSG_EMPTY = "URL is empty"
MSG_SCHEME = "URL must start with http:// or https://"
MSG_TOO_LONG = "URL is too long (max 2048 chars)"
MAX_URL_LENGTH = 2048

# Scheme, then optional //netloc, as a generic URL splitter does it: the scheme
# is everything before the first ':' when it starts with a letter and holds only
# letters, digits, '+', '-' and '.'.
_SCHEME = r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?"
HOST_RE = f"^{_SCHEME}//([^/?#]*)"
PATH_RE = f"^{_SCHEME}(?://[^/?#]*)?([^?#]*)"
PARAMS_RE = r";[^/]*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def validate_url(url) -> Column:
    """NULL when the URL is acceptable, else the error message."""
    u = strip_ws(F.coalesce(_c(url), F.lit("")))
    return (F.when(F.length(u) == 0, F.lit(MSG_EMPTY))
            .when(~(u.startswith("http://") | u.startswith("https://")), F.lit(MSG_SCHEME))
            .when(F.length(u) > MAX_URL_LENGTH, F.lit(MSG_TOO_LONG)))


def normalize_url(url) -> Column:
    """Strip; prefix https:// when there is no http(s) scheme."""
    u = strip_ws(F.coalesce(_c(url), F.lit("")))
    return F.when(u.startswith("http://") | u.startswith("https://"), u) \
        .otherwise(F.concat(F.lit("https://"), u))


def _unsafe_removed(u: Column) -> Column:
    return F.regexp_replace(u, r"[\t\r\n]", "")


def url_host(url_norm: Column) -> Column:
    """Host part used by ranking: netloc when the URL holds '://', else the whole URL."""
    u = _unsafe_removed(url_norm)
    return F.when(url_norm.contains("://"), F.regexp_extract(u, HOST_RE, 1)).otherwise(url_norm)


def url_path(url_norm: Column) -> Column:
    """Path part used by ranking (';params' of the last segment cut); '' without '://'."""
    u = _unsafe_removed(url_norm)
    path = F.regexp_replace(F.regexp_extract(u, PATH_RE, 1), PARAMS_RE, "")
    return F.when(url_norm.contains("://"), path).otherwise(F.lit(""))


def fuzzy_host(url) -> Column:
    """Host used by the typo fallback: netloc when the URL holds '//', else the URL."""
    u = norm(url)
    return F.when(u.contains("//"), F.regexp_extract(_unsafe_removed(u), HOST_RE, 1)).otherwise(u)


def quote(c) -> Column:
    """Percent-encode for a query string: letters, digits, '_.-~' and '/' stay."""
    enc = F.url_encode(_c(c))
    enc = F.replace(enc, F.lit("+"), F.lit("%20"))
    enc = F.replace(enc, F.lit("*"), F.lit("%2A"))
    enc = F.replace(enc, F.lit("%7E"), F.lit("~"))
    return F.replace(enc, F.lit("%2F"), F.lit("/"))


def client_key(forwarded_for, peer) -> Column:
    """First forwarded-for entry, else the peer address, else 'unknown'."""
    f = _c(forwarded_for)
    p = _c(peer)
    first = strip_ws(F.split(f, ",").getItem(0))
    return (F.when(f.isNotNull() & (F.length(f) > 0), first)
            .when(p.isNotNull(), p)
            .otherwise(F.lit("unknown")))
