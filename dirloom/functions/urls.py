"""URL algebra as Column expressions.

A URL is taken apart by one pattern (scheme, authority, path, query), as the
built-in parser rejects hosts and paths that pages do have.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import patterns as P
from .text import let, tokens

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _PARTS, 1))


def authority(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _PARTS, 2))


def path(u: Column) -> Column:
    return F.regexp_extract(u, _PARTS, 3)


def query(u: Column) -> Column:
    return F.regexp_extract(u, _PARTS, 4)


def bare_host(u: Column) -> Column:
    return F.regexp_replace(authority(u), r"^www\.", "")


def _resolved_path(base: Column, p: Column) -> Column:
    """RFC 3986, 5.2: a reference's path after a base's, without dot segments."""
    parts = F.split(base, "/")
    folder = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))  # of an empty path: its one empty part
    inner = F.filter(F.concat(folder, F.split(p, "/")), lambda s, i: (i == 0) | (s != ""))
    ends = F.when(p.endswith("/"), F.array_append(inner, F.lit(""))).otherwise(inner)
    segments = F.when(p.startswith("/"), F.split(p, "/")).otherwise(ends)
    none = F.array().cast("array<string>")

    def step(done: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s))

    tail = F.when(p.rlike(r"(^|/)\.\.?$"), F.array(F.lit(""))).otherwise(none)
    whole = F.array_join(F.concat(F.reduce(segments, none, step), tail), "/")
    return F.when(whole.startswith("/"), whole).otherwise(F.concat(F.lit("/"), whole))


def absolute_url(href: Column, base: Column) -> Column:
    """The http(s) URL that a reference means, or ``""``: RFC 3986 resolution, but that full
    references keep their paths as they stand."""
    h = F.replace(F.replace(F.trim(F.regexp_replace(F.coalesce(href, F.lit("")), r"[\t\r\n]", "")), F.lit("\\"), F.lit("/")), F.lit(" "), F.lit("%20"))

    def resolved(h: Column) -> Column:
        p, q = path(h), query(h)
        root = F.concat(scheme(base), F.lit("://"), authority(base))
        at = F.when(p == "", path(base)).when(p.startswith("/") & ~F.contains(p, F.lit("/.")), p).otherwise(_resolved_path(path(base), p))
        asked = F.when((p == "") & (q == ""), query(base)).otherwise(q)
        relative = F.concat(root, at, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))
        own = scheme(h)
        simple = F.when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h)).when((own != "") & ((own != scheme(base)) | F.contains(h, F.lit("://"))), h).when(scheme(base).isin("http", "https"), relative)
        return F.when((h == "") | h.rlike(r"^(data:|javascript:|mailto:|tel:|#|about:)"), F.lit("")).otherwise(F.coalesce(simple, F.lit("")))

    def tidy(u: Column) -> Column:
        p, q = path(u), query(u)
        whole = F.concat(scheme(u), F.lit("://"), authority(u), F.when(p == "", "/").otherwise(p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
        return F.when(scheme(u).isin("http", "https"), whole).otherwise(F.lit(""))

    return let(let(h, resolved), tidy)


def query_pairs(u: Column, keep_blank: bool = True) -> Column:
    """(key, value) structs of the query, decoded, in order."""
    items = F.filter(F.split(query(u), "&"), lambda x: (x != "") if keep_blank else F.contains(x, F.lit("=")) & ~x.endswith("="))

    def plain(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    return F.transform(
        items,
        lambda x: F.struct(
            plain(F.substring_index(x, "=", 1)).alias("k"),
            plain(F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")).alias("v"),
        ),
    )


def joined_pairs(pairs: Column) -> Column:
    def encoded(c: Column) -> Column:
        return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    return F.array_join(F.transform(pairs, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")


def canonical_url(u: Column) -> Column:
    """Key of a page: no scheme, fragment, ``www.`` or last slash; sorted query."""
    p = F.regexp_replace(path(u), "/+$", "")
    q = joined_pairs(F.array_sort(query_pairs(u)))
    return F.concat(bare_host(u), F.when(p == "", "/").otherwise(p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def listing_key(u: Column) -> Column:
    """What the pages of one paged list share."""
    p = F.regexp_replace(F.regexp_replace(path(u), r"/page/\d+/?$", ""), "/+$", "")
    pairs = F.filter(query_pairs(u, keep_blank=False), lambda x: ~F.lower(x["k"]).isin(P.PAGE_PARAMS))
    return F.concat_ws("|", bare_host(u), p, joined_pairs(F.array_sort(pairs)))


def url_extension(u: Column) -> Column:
    return F.regexp_extract(F.lower(path(u)), r"\.[a-z0-9]{2,5}$", 0)


def site_key(u: Column) -> Column:
    """The registered domain of a URL."""
    host = F.regexp_replace(F.regexp_replace(authority(u), r"^.*@", ""), r":\d*$", "")
    two = F.lit(False)
    for s in P.TWO_LEVEL_SUFFIXES:
        two |= host.endswith(s)
    return F.when(two, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def unwrap_image_proxy(u: Column) -> Column:
    """The picture behind an image proxy's URL."""
    inner = F.element_at(F.filter(query_pairs(u), lambda p: p["k"] == "url"), 1)["v"]
    root = F.concat(scheme(u), F.lit("://"), authority(u))
    rest = F.regexp_extract(path(u), r"^/_ipx/[^/]+(/.+)$", 1)
    full = F.when(inner.rlike("^https?://"), inner).otherwise(F.concat(root, inner))
    proxied = path(u).endswith("/_next/image") & (F.size(F.filter(query_pairs(u), lambda p: (p["k"] == "url") & (p["v"] != ""))) > 0)
    return F.when(proxied, full).when(rest != "", F.concat(root, rest)).otherwise(u)


def image_identity(u: Column) -> Column:
    """Path that the sizes of one picture share."""
    return F.regexp_replace(F.lower(path(u)), r"[-_]\d{2,4}x\d{2,4}(?=\.\w+$)", "")


def full_size_variants(u: Column) -> Column:
    """URLs of the original of a resized picture, best first, itself last."""
    p = path(u)
    pairs = F.filter(query_pairs(u, keep_blank=False), lambda x: ~F.lower(x["k"]).isin(P.SIZE_PARAMS))
    q = joined_pairs(pairs)
    root = F.concat(scheme(u), F.lit("://"), authority(u))

    def variant(new: Column) -> Column:
        return F.when(new != p, F.concat(root, new, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))

    small = variant(F.regexp_replace(p, r"-\d{2,4}x\d{2,4}(?=\.\w{3,4}$)", ""))
    styled = variant(F.regexp_replace(p, r"/styles/[^/]+/(public|private)/", "/"))
    return F.array_distinct(F.array_compact(F.array(small, styled, u)))


def is_social(u: Column) -> Column:
    """Does the host hold one of the social hosts' names?"""
    out = F.lit(False)
    for h in P.SOCIAL_HOSTS:
        out |= F.contains(authority(u), F.lit(h))
    return out


def is_placeholder_image(u: Column) -> Column:
    """Generic portraits by file name, unless their folder has a number."""
    p = F.lower(path(u))
    stem = F.regexp_replace(F.regexp_replace(F.substring_index(p, "/", -1), r"\.[a-z0-9]{2,5}$", ""), r"[-_]?\d+x\d+$", "")
    folder = F.regexp_replace(p, "/[^/]*$", "")
    named = F.lit(False)
    for t in P.PLACEHOLDER_TOKENS:
        named |= F.contains(p, F.lit(t))
    return (stem.isin(P.PLACEHOLDER_FILENAMES) & ~folder.rlike(r"\d")) | named


def is_junk_image_url(u: Column) -> Column:
    """Decoration, judged by the URL alone."""
    p = F.lower(path(u))
    junk = F.arrays_overlap(tokens(p), F.array(*(F.lit(t) for t in P.JUNK_TOKENS)))
    return url_extension(u).isin(".svg", ".ico") | p.rlike("/themes/|/plugins/|/emoji") | junk


def matches_any(u: Column, regexes: list[str] | Column) -> Column:
    """``regexes``: fixed ones, or an array column (rules of a site)."""
    if isinstance(regexes, Column):
        return F.exists(regexes, lambda r: F.rlike(u, r))
    out = F.lit(False)
    for r in regexes:
        out |= u.rlike(r)
    return out


def is_allowed(u: Column, domains: list[str] | Column, blocked: list[str] | Column, exclude: list[str] | Column) -> Column:
    """May a crawler of these domains read the page?  Rules are fixed lists or array columns."""
    host = F.regexp_replace(authority(u), r":\d*$", "")
    if isinstance(domains, Column):
        inside = F.exists(domains, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    else:
        inside = F.lit(False)
        for d in domains:
            inside |= (host == d) | host.endswith("." + d)
    stopped = F.array_contains(blocked, host) if isinstance(blocked, Column) else host.isin(blocked)
    unwanted = stopped | F.substring_index(host, ".", 1).isin(P.UNWANTED_SUBDOMAINS)
    files = url_extension(u).isin(list(P.IMAGE_EXTENSIONS + P.DOCUMENT_EXTENSIONS))
    return inside & ~unwanted & ~files & ~matches_any(u, exclude)


def is_listing_url(u: Column, listing: list[str] | Column, profile: list[str] | Column) -> Column:
    return matches_any(u, listing) | (path(u).rlike(P.LISTING_URL) & ~matches_any(u, profile))


def worth_following(u: Column, text: Column, follow: list[str] | Column) -> Column:
    where = F.concat(path(u), F.lit("?"), query(u))
    return ~where.rlike(P.EXCLUDE_URL) & (matches_any(u, follow) | where.rlike(P.FOLLOW_URL) | F.coalesce(text, F.lit("")).rlike(P.FOLLOW_TEXT))


def is_staff_only(u: Column) -> Column:
    return path(u).rlike(P.STAFF_ONLY) & ~path(u).rlike(P.TEACHING_STAFF)
