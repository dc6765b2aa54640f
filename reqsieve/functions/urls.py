"""URL and argument handling without ``parse_url``.

``parse_url``, ``str_to_map`` and ``url_decode`` raise on just the text attack traffic
is made of, so everything here is made of regular expressions and total functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BAD_PERCENT = "%(?![0-9A-Fa-f]{2})"
# A URL that can be taken as it is: its path holds only bytes that may stand there
# unescaped, and nothing in it is a control character. One pass settles most traffic.
_CLEAN = r"^(?!:)(?:[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]]|%[0-9A-Fa-f]{2})*+(?:[?#][^\x00-\x1F\x7F]*+)?\z"
_CONTROL = r"[\x00-\x1F\x7F]"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
_PARTS = rf"(?s)({_SCHEME}[^/?#]*)?([^?#]*)(.*)$"
# Characters of a path that URL encoding escapes but paths keep, and one it keeps.
_KEPT_IN_PATHS = "~$&+,/:;=@"


def lenient_decode(text: Column, plus_is_space: bool = True) -> Column:
    """Percent-decoding that leaves broken escapes as they are."""
    safe = F.regexp_replace(text, _BAD_PERCENT, "%25")
    if not plus_is_space:
        safe = F.replace(safe, F.lit("+"), F.lit("%2B"))
    needed = F.contains(text, F.lit("%")) | F.contains(text, F.lit("+"))
    return F.when(needed, F.url_decode(safe)).otherwise(text)


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def _relative(url: Column) -> Column:
    return url.startswith("/")


def url_host(url: Column, authority: bool = False) -> Column:
    """Host (with port) of an absolute URL, else empty.

    With ``authority`` what follows ``//`` is a host too; in a request line it is a path.
    """
    host = F.regexp_extract(url, rf"{_SCHEME}(?:[^/?#@]*@)?([^/?#]*)", 1)
    found = F.when(_relative(url), F.lit("")).otherwise(host)
    if not authority:
        return found
    return F.when(url.startswith("//"), F.regexp_extract(url, r"^//(?:[^/?#@]*@)?([^/?#]*)", 1)).otherwise(found)


def url_target(url: Column, authority: bool = False) -> Column:
    """Path and query of a URL, without scheme, host and fragment."""
    bare = without_fragment(url)
    target = F.when(_relative(url), bare).otherwise(F.regexp_replace(bare, rf"{_SCHEME}[^/?]*", ""))
    return F.when(bare.startswith("//"), F.regexp_replace(bare, "^//[^/?]*", "")).otherwise(target) if authority else target


def url_path(url: Column, authority: bool = False) -> Column:
    """Path as written, without query and fragment."""
    return F.substring_index(url_target(url, authority), "?", 1)


def url_query(url: Column) -> Column:
    """Everything after the first ``?`` up to the fragment."""
    bare = without_fragment(url)
    start = F.instr(bare, "?")
    return F.when(start > 0, F.substr(bare, start + 1)).otherwise(F.lit(""))


def canonical_url(url: Column) -> Column:
    """The URL as it is shown and matched: a path with unsafe characters is re-escaped.

    Query and fragment stay as written, and so does a path that is well formed or that
    cannot be parsed at all (see ``url_problem``).
    """
    head, path, tail = (F.regexp_extract(url, _PARTS, i) for i in (1, 2, 3))
    escaped = F.url_encode(lenient_decode(path, plus_is_space=False))
    escaped = F.replace(escaped, F.lit("+"), F.lit("%20"))
    escaped = F.replace(escaped, F.lit("*"), F.lit("%2A"))
    for c in _KEPT_IN_PATHS:
        escaped = F.replace(escaped, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return (
        F.when(url.rlike(_CLEAN) | url_problem(url).isNotNull(), url)
        .otherwise(F.concat(head, escaped, tail))
    )


def url_problem(url: Column) -> Column:
    """Why a URL cannot be parsed, or NULL."""
    return (
        F.when(url.rlike(_CLEAN), F.lit(None))
        .when(url.rlike(_CONTROL), F.lit("control character in url"))
        .when(url_path(url).rlike(_BAD_PERCENT), F.lit("bad escape in path"))
        .when(url.startswith(":"), F.lit("missing scheme"))
    )


def parse_pairs(text: Column) -> Column:
    """``a=1&b=2`` as ``array<struct<k,v>>``, decoded; empty pieces are left out.

    An array, because argument names may repeat.
    """
    pieces = F.filter(F.split(text, "&"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            lenient_decode(F.substring_index(p, "=", 1)).alias("k"),
            lenient_decode(
                F.when(F.contains(p, F.lit("=")), F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).otherwise(F.lit(""))
            ).alias("v"),
        ),
    )


def is_form(headers: Column) -> Column:
    kind = F.coalesce(F.try_element_at(headers, F.lit("Content-Type")), F.lit(""))
    return F.lower(kind).startswith("application/x-www-form-urlencoded")


def extract_args(query: Column, body: Column, headers: Column, body_access: bool = True) -> Column:
    """Arguments of the query string and, for form posts, of the body."""
    from_query = parse_pairs(query)
    if not body_access:
        return from_query
    none = F.array().cast("array<struct<k:string,v:string>>")
    return F.concat(from_query, F.when(is_form(headers), parse_pairs(body)).otherwise(none))
