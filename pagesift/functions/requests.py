"""Request URLs: merge parameters into a URL's query string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _decoded(x) -> Column:
    """Percent-decoded text; a text that is not valid percent-encoding stays as it is."""
    return F.coalesce(F.try_url_decode(x), x)


def with_params(url, params) -> Column:
    """URL with ``params`` merged into its query.

    ``params`` is a dict, or a map<string, string> column (its own for each
    row). The result has one entry per key: a key that the URL has keeps its
    first place and takes the new value, or else its last value in the URL;
    new keys follow in the given order. Entries of the URL without a value
    (``a=``, ``a``) are dropped, as the reference does. Keys and values are
    percent-encoded with '+' for spaces; a fragment is kept at the end; a null
    URL stays null, a null map adds nothing.
    """
    u = _c(url)
    frag = F.when(F.instr(u, "#") > 0, F.substring(u, F.instr(u, "#") + 1, 1 << 30))
    no_frag = F.substring_index(u, "#", 1)
    base = F.substring_index(no_frag, "?", 1)
    query = F.when(F.instr(no_frag, "?") > 0,
                   F.substring(no_frag, F.instr(no_frag, "?") + 1, 1 << 30))
    pairs = F.filter(F.split(F.coalesce(query, F.lit("")), "&", -1), lambda x: F.instr(x, "=").between(1, F.length(x) - 1))
    entries = F.transform(pairs, lambda p: F.struct(
        _decoded(F.substring(p, 1, F.instr(p, "=") - 1)).alias("k"),
        _decoded(F.substring(p, F.instr(p, "=") + 1, 1 << 30)).alias("v")))
    none = F.create_map().cast("map<string,string>")
    if isinstance(params, dict):
        pm = F.create_map(*[F.lit(x) for kv in params.items() for x in kv]) if params else none
    else:
        pm = F.coalesce(_c(params), none)
    keys = F.array_distinct(F.concat(F.transform(entries, lambda e: e["k"]), F.map_keys(pm)))

    def value(k):
        own = F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]
        return F.when(F.map_contains_key(pm, k), F.try_element_at(pm, k)).otherwise(own)

    qs = F.array_join(F.transform(keys, lambda k: F.concat(F.url_encode(k), F.lit("="), F.url_encode(F.coalesce(value(k), F.lit(""))))), "&")
    out = F.when(F.size(keys) > 0, F.concat(base, F.lit("?"), qs)).otherwise(base)
    return F.when(frag.isNotNull(), F.concat(out, F.lit("#"), frag)).otherwise(out)
