"""URL columns. Built on regexes: ``try_parse_url`` gives NULL for raw non-ASCII and blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions.text import behind, has_any, let

# Query keys that only track where a click came from.
TRACKING_KEYS = (
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "fbclid",
    "gclid",
)
# Query keys that carry an offer id, in order of preference.
EXTERNAL_ID_KEYS = ("EventId", "eventId", "event_id", "id", "nID")
IDENTIFIER_KEYS = ("eventid", "id", "event_id", "nid")

MENTIONED_URL = r"https?://[^\s<>'\"]+"
_SCHEME = r"\A([A-Za-z][A-Za-z0-9+.\-]*):"
# An address in its canonical spelling already: no query, fragment, blank or upper-case host.
_PLAIN = r"\A[a-z][a-z0-9+.\-]*://[a-z0-9.:@_\-]+/[^?#\x00-\x20]*\z"


def clean_url(url: Column) -> Column:
    cleaned = F.regexp_replace(url, r"\A[\x00-\x20]+|[\x00-\x20]+\z|[\t\r\n]", "")
    return F.when(url.rlike(r"[\x00-\x20]"), cleaned).otherwise(url)


def _scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _SCHEME, 1))


def _authority(u: Column) -> Column:
    return F.regexp_extract(u, r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def _path(u: Column) -> Column:
    return F.regexp_extract(u, r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def _query(u: Column) -> Column:
    bare = F.substring_index(u, "#", 1)
    return let(bare, lambda b: F.coalesce(behind(b, "?"), F.lit("")))


def url_scheme(url: Column) -> Column:
    return _scheme(clean_url(url))


def url_authority(url: Column) -> Column:
    return _authority(clean_url(url))


def url_host(url: Column) -> Column:
    """Host without user info, port and trailing dots, in lower case."""
    host = F.regexp_replace(F.regexp_replace(url_authority(url), r"\A.*@", ""), r":\d*\z", "")
    return F.lower(F.regexp_replace(host, r"\.+\z", ""))


def url_path(url: Column) -> Column:
    return _path(clean_url(url))


def url_query(url: Column) -> Column:
    return _query(clean_url(url))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encode(text: Column) -> Column:
    # Java keeps "*" and escapes "~"; the web form convention used for keys is the reverse.
    encoded = F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(text.rlike(r"[^A-Za-z0-9._~\-]"), encoded).otherwise(text)


def _params(query: Column) -> Column:
    def split(query: Column, decode) -> Column:
        return F.transform(
            F.filter(F.split(query, "&"), lambda p: p != ""),
            lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), decode(behind(p, "=")).alias("v")),
        )

    return let(query, lambda q: F.when(has_any(q, "%+"), split(q, _decode)).otherwise(split(q, lambda x: x)))


def query_params(url: Column, keep_blank: bool = True) -> Column:
    """Decoded ``array<struct<k,v>>`` in query order."""
    params = _params(url_query(url))
    kept = params if keep_blank else F.filter(params, lambda p: p["v"] != "")
    return F.when(url.contains("?"), kept).otherwise(F.array().cast("array<struct<k:string,v:string>>"))


def _remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    folded = F.aggregate(
        F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..",
            F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc),
        )
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    tail = F.when(path.rlike(r"/\.{1,2}\z"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(folded, "/"), tail)


def resolve_url(url: Column, base: Column) -> Column:
    """Absolute form of a reference found on the page ``base``."""
    url, base = clean_url(url), clean_url(base)
    root = F.concat(url_scheme(base), F.lit("://"), url_authority(base))
    base_path = F.when(url_path(base) == "", F.lit("/")).otherwise(url_path(base))
    folder = F.regexp_replace(base_path, r"[^/]*\z", "")
    path, rest = F.regexp_extract(url, r"\A([^?#]*)", 1), F.regexp_extract(url, r"\A[^?#]*([\s\S]*)\z", 1)
    return (
        F.when(url.rlike(_SCHEME), url)
        .when(url.startswith("//"), F.concat(url_scheme(base), F.lit(":"), url))
        .when(url == "", base)
        .when(url.startswith("#"), F.concat(without_fragment(base), url))
        .when(url.startswith("?"), F.concat(root, url_path(base), url))
        .when(url.startswith("/"), F.concat(root, _remove_dots(path), rest))
        .otherwise(F.concat(root, _remove_dots(F.concat(folder, path)), rest))
    )


def _canonical(u: Column) -> Column:
    kept = F.filter(_params(_query(u)), lambda p: ~F.lower(p["k"]).isin(*TRACKING_KEYS))
    query = F.array_join(
        F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )
    parts = F.struct(
        _scheme(u).alias("s"),
        F.lower(_authority(u)).alias("a"),
        _path(u).alias("p"),
        F.when(u.contains("?"), query).otherwise(F.lit("")).alias("q"),
    )
    return let(
        parts,
        lambda x: F.concat(
            F.when(x["a"] != "", F.concat(x["s"], F.lit("://"), x["a"]))
            .when(x["s"] != "", F.concat(x["s"], F.lit(":")))
            .otherwise(F.lit("")),
            F.when(x["p"] == "", F.lit("/")).otherwise(x["p"]),
            F.when(x["q"] != "", F.concat(F.lit("?"), x["q"])).otherwise(F.lit("")),
        ),
    )


def canonical_url(url: Column, base: Column | None = None) -> Column:
    """One spelling per page: lower-case host, sorted query, no tracking keys, no fragment."""
    spelled = let(clean_url(url) if base is None else resolve_url(url, base), _canonical)
    return F.when(url.rlike(_PLAIN), url).otherwise(spelled) if base is None else spelled


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` gives ``[a.b.c, b.c, c]``: a dot-suffix test becomes an equality test."""
    labels = F.split(host, r"\.")
    return F.when(
        host != "",
        F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        ),
    ).otherwise(F.array().cast("array<string>"))


def external_id(url: Column) -> Column:
    """Offer id from the query, else a last path part that looks like one, else NULL."""
    params = query_params(url, keep_blank=False)
    named = lambda key: F.get(F.filter(params, lambda p: p["k"] == key), 0)["v"]
    from_query = [named(key) for key in EXTERNAL_ID_KEYS]
    last = F.regexp_extract(url_path(url), r"([^/]*)/*\z", 1)
    return F.coalesce(*from_query, F.when(last.rlike(r"\A[A-Za-z0-9_-]{8,}\z"), last))


def strict_event_id(url: Column, host: str, path: str, key: str = "EventId") -> Column:
    """Digits of ``key`` when scheme, host and path are exactly the expected ones, else NULL."""
    value = F.get(F.filter(query_params(url, keep_blank=False), lambda p: p["k"] == key), 0)["v"]
    return F.when(
        (url_scheme(url) == "https") & (url_host(url) == host) & (url_path(url) == path) & value.rlike(r"\A\d+\z"),
        value,
    )


def event_identifiers(url: Column, text: Column) -> Column:
    """Distinct identifiers a page is known by: id-like query values and ids named in its text."""
    keyed = F.filter(
        query_params(url, keep_blank=False), lambda p: F.lower(p["k"]).isin(*IDENTIFIER_KEYS)
    )
    named = F.when(
        F.lower(text).contains("event") | text.contains("活動編號"),
        F.regexp_extract_all(text, F.lit(r"(?iu)(?:event_?id|活動編號)(?U:[=:：\s]+)([A-Za-z0-9_-]{2,})"), F.lit(1)),
    )
    return F.array_distinct(
        F.concat(
            F.transform(keyed, lambda p: F.lower(p["v"])),
            F.transform(F.coalesce(named, F.array().cast("array<string>")), F.lower),
        )
    )


def mentioned_urls(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?U)" + MENTIONED_URL), F.lit(0))
    cut = F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,);\]]+\z", "")))
    return F.when(text.contains("://"), cut).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def identity_text(policy: str, provider_id: Column, provider_name: Column, external: Column, url: Column, title: Column) -> Column:
    """What makes an offer the same offer; the store, the publisher and the digest differ."""
    ext = F.nullif(external, F.lit(""))
    if policy == "store":
        return F.coalesce(F.concat(F.lit("id:"), ext), canonical_url(url))
    if policy == "publish":
        return F.coalesce(F.concat(F.lit("id:"), F.nullif(F.trim(external), F.lit(""))), F.concat(F.lit("url:"), F.coalesce(url, F.lit(""))))
    if policy == "digest":
        return F.coalesce(ext, F.nullif(url, F.lit("")), F.nullif(title, F.lit("")), F.lit(""))
    raise ValueError(f"unknown key policy {policy!r}")


def activity_id(provider_id: Column, identity: Column) -> Column:
    return F.substring(F.sha2(F.concat(provider_id, F.lit("\0"), identity), 256), 1, 24)
