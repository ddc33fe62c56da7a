"""Canonical URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track visitors, and ports that need not be named.
TRACKING = r"(?i)^(utm_.*|ref|sessionid|sid|fbclid|gclid)$"
DEFAULT_PORTS = {"http": "80", "https": "443"}
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _unquote(text: Column) -> Column:
    # url_decode takes "+" for a blank, a path doesn't.
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def host(url: Column) -> Column:
    authority = F.regexp_extract(F.trim(url), _PARTS, 2)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", ""))


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment or tracking, parameters in order, dots and slashes resolved."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, _PARTS, 1))
    scheme = F.when(scheme == "", F.lit("https")).otherwise(scheme)
    port = F.regexp_extract(F.regexp_extract(u, _PARTS, 2), r":(\d+)$", 1)
    default = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv]), scheme), F.lit(""))
    netloc = F.when((port == "") | (port == default), host(url)).otherwise(F.concat_ws(":", host(url), port))
    steps = F.filter(F.split(_unquote(F.regexp_extract(u, _PARTS, 3)), "/"), lambda s: (s != "") & (s != "."))
    path = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    pairs = F.filter(F.split(F.regexp_extract(u, _PARTS, 4), "&"), lambda p: p != "")
    cut = F.transform(pairs, lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.coalesce(F.try_url_decode(F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, "=") + 1)).otherwise(F.lit(""))), F.lit("")).alias("v")))
    known = F.array_sort(F.filter(cut, lambda x: ~x["k"].rlike(TRACKING)))
    query = F.array_join(F.transform(known, lambda x: F.concat_ws("=", F.url_encode(x["k"]), F.url_encode(x["v"]))), "&")
    base = F.concat(scheme, F.lit("://"), netloc, F.lit("/"), F.array_join(path, "/"))
    return F.when(query == "", base).otherwise(F.concat_ws("?", base, query))
