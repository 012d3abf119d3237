"""Scalar column functions (strings, URLs, JSON, time, numbers).

Every function returns a ``Column`` built only from built-in Spark expressions,
so it stays inside whole-stage code generation and needs no Python worker.
"""

from sitelens.functions.text import (  # noqa: F401
    WS,
    clean_text,
    count_sub,
    norm,
    py_split,
    strip_ws,
    tag_tokens,
)
from sitelens.functions.numeric import days_between, floor_div, py_round  # noqa: F401
from sitelens.functions.urls import (  # noqa: F401
    client_key,
    fuzzy_host,
    normalize_url,
    quote,
    url_host,
    url_path,
    validate_url,
)
from sitelens.functions.parse import (  # noqa: F401
    as_of_col,
    ntz_lit,
    decode_json_array,
    decode_json_map,
    decode_json_struct,
    icon_key,
    normalize_hex,
    parse_ts,
)
