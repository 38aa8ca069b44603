"""URL algebra as Spark expressions: normalization, keys, globs, host guards, source mapping."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"(?i)^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_RAW = "https://raw.githubusercontent.com/"
_CDN = "sf-zdocs-cdn-prod.zoominsoftware.com"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with its mark, 5 fragment with its mark; '' where there is none."""
    return F.regexp_extract(url, _URL, group)


def _dots(x: Column) -> Column:
    return F.regexp_replace(x, "(?i)%2e", ".")


def _steps(path: Column) -> Column:
    """A path without `.` and `..` steps; `..` at the top stays there."""
    parts = F.split(path, "/")
    end = F.when(_dots(F.element_at(parts, -1)).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))

    def step(kept: Column, x: Column) -> Column:
        back = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(_dots(x) == "..", back).when(_dots(x) == ".", kept).otherwise(F.array_append(kept, x))

    return F.array_join(F.concat(F.aggregate(parts, F.array().cast("array<string>"), step), end), "/")


def resolve(base: Column, href: Column) -> Column:
    """The address that a link on a page leads to; null where the base is no http address. Queries and fragments stay."""
    link = trim_all(href)
    origin = F.concat(F.lower(part(base, 1)), F.lit("://"), F.lower(part(base, 2)))
    path, rest = F.regexp_extract(link, r"^([^?#]*)(.*)$", 1), F.regexp_extract(link, r"^([^?#]*)(.*)$", 2)
    own = F.when(part(base, 3) == "", "/").otherwise(part(base, 3))
    target = F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_extract(own, "^(.*/)", 1), path))
    out = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.lower(part(base, 1)), F.lit(":"), link))
    out = out.when(link == "", F.concat(origin, own, part(base, 4))).when(link.startswith("#"), F.concat(origin, own, part(base, 4), link))
    out = out.when(link.startswith("?"), F.concat(origin, own, link)).otherwise(F.concat(origin, _steps(target), rest))
    return F.when(part(base, 2) != "", out)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(part(url, 2)), r":\d*$", "")


def url_error(url: Column) -> Column:
    """Why a URL is refused, or null."""
    shaped = url.rlike(r"^[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}(?::\d+)?(?:[/?#].*)?$")
    return (
        F.when(shaped, "missing_scheme")
        .when(url.isNull() | ~url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "unparsable")
        .when(~url.rlike(r"(?i)^https?:"), "unsupported_protocol")
        .when(~url.rlike(_URL) | (host(url) == ""), "unparsable")
        .when(part(url, 2).contains("@"), "credentials")
        .when(let(host(url), blocked_host), "blocked_host")
    )


def _form_decoded(x: Column) -> Column:
    """A name or value of a query: plus signs are blanks, broken percent signs stay."""
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def _escaped(x: Column, more: str) -> Column:
    """Characters that may not stand in a path or fragment as percent codes; what is a code already stays."""
    odd = rf"[^\x21-\x7E]|[{more}]"
    each = F.transform(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c == " ", "%20").when(c.rlike(odd), F.url_encode(c)).otherwise(c))
    return F.when(x.rlike(odd), F.array_join(each, "")).otherwise(x)


def normalize_url(url: Column) -> Column:
    """Lower-cased host without default port, dot steps resolved, query in form encoding and sorted, plain fragments
    dropped and SPA routes kept. Null if refused. Pairs are in the order of the collation, equal ones as they stand; hosts
    with other letters than ASCII stay as written."""
    url = F.regexp_replace(trim_all(url), r"[\t\n\r]", "")
    scheme, path, query, fragment = F.lower(part(url, 1)), F.replace(part(url, 3), F.lit("\\"), F.lit("/")), part(url, 4), part(url, 5)
    authority = F.lower(part(url, 2))
    authority = F.when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(F.regexp_replace(authority, ":80$", ""))
    path = F.when(path.rlike(r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)"), _steps(path)).otherwise(path)
    pairs = F.filter(F.split(F.substring(query, 2, 1 << 30), "&"), lambda x: x != "")
    pairs = F.transform(
        pairs, lambda x: F.struct(_form_decoded(F.substring_index(x, "=", 1)).alias("k"), F.when(x.contains("="), _form_decoded(F.regexp_extract(x, "(?s)=(.*)$", 1))).otherwise("").alias("v"))
    )
    pairs = F.array_sort(F.transform(pairs, lambda p, i: F.struct(F.collate(p["k"], "UNICODE").alias("a"), F.collate(p["v"], "UNICODE").alias("b"), i.alias("i"), p["k"].alias("k"), p["v"].alias("v"))))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    out = F.concat(
        scheme,
        F.lit("://"),
        authority,
        F.when(path == "", "/").otherwise(_escaped(path, '"<>`{}')),
        F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""),
        F.when(fragment.rlike("^#!?/"), _escaped(fragment, '"<>`')).otherwise(""),
    )
    return F.when(url_error(url).isNull(), out)


def cache_key(normalized: Column) -> Column:
    return F.sha2(normalized, 256)


def import_key(topic: Column, urls: Column) -> Column:
    """Key of a note with several sources: topic, then its normalized URLs in code-unit order."""
    return F.sha2(F.concat_ws("|", F.lower(trim_all(topic)), F.array_join(F.array_sort(urls), "|")), 256)


def child_key(parent: Column, anchor: Column) -> Column:
    return F.sha2(F.concat(parent, F.lit("#"), anchor), 256)


def trim_all(text: Column) -> Column:
    """Trims all white space, as the SQL trim, which takes spaces alone, doesn't."""
    return F.regexp_replace(text, r"^[\s ﻿]+|[\s ﻿]+$", "")


def glob_match(url: Column, glob: str) -> Column:
    """Case-insensitive match of the whole URL; runs of * are one wildcard, which doesn't cross a line."""
    pattern = ".*".join(re.escape(x) for x in re.sub(r"\*+", "*", glob.lower()).split("*"))
    return F.lower(url).rlike(f"^{pattern}$")


def any_glob_match(urls: Column, glob: str) -> Column:
    return F.exists(urls, lambda u: glob_match(u, glob))


def let(value: Column, body) -> Column:
    """body(value) with value named once, so that a plan doesn't repeat it wherever the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def safe_ipv4(ip: Column) -> Column:
    """False for loopback, private and link-local ranges, null if it is no IPv4 literal."""
    local = r"^0*(?:127|10|172\.0*(?:1[6-9]|2\d|3[01])|192\.0*168|169\.0*254)\."
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), ~ip.rlike(local))


def safe_ipv6(ip: Column) -> Column:
    """False for loopback, unspecified, link-local and unsafe mapped addresses, null if it is no IPv6 literal."""
    x = F.lower(ip)
    mapped = F.regexp_extract(x, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    return F.when(
        x.rlike("^[0-9a-f:.]*:[0-9a-f:.]*$"),
        ~(x.isin("::1", "::", "0:0:0:0:0:0:0:1", "0:0:0:0:0:0:0:0") | x.rlike("^fe[89ab]")) & F.coalesce(F.when(mapped != "", safe_ipv4(mapped)), F.lit(True)),
    )


def safe_ip(ip: Column) -> Column:
    """False for what is no IP as well."""
    return F.coalesce(safe_ipv4(ip), safe_ipv6(ip), F.lit(False))


def numeric_host(name: Column) -> Column:
    """Hosts of one to four decimal, octal or hexadecimal numbers as dotted decimals; other names as they are."""
    number = r"(?:0[xX][0-9a-fA-F]{0,8}|[0-9]{1,11})"

    def value(x: Column) -> Column:
        digits = F.when(x.startswith("0x"), F.conv(F.concat(F.lit("0"), F.substring(x, 3, 8)), 16, 10)).when(x.rlike("^0[0-7]+$"), F.conv(x, 8, 10)).otherwise(x)
        return digits.try_cast("long")

    def total(values: Column) -> Column:
        # The last number fills what the ones before it leave.
        lead = F.aggregate(F.slice(values, F.lit(1), F.size(values) - 1), F.lit(0).cast("long"), lambda t, x: t * 256 + x)
        last = F.try_element_at(values, F.lit(-1))
        return F.when(F.size(values) == 4, lead * 256 + last).when(F.size(values) == 3, lead * 65536 + last).when(F.size(values) == 2, lead * 16777216 + last).otherwise(last)

    def dotted(address: Column) -> Column:
        parts = [F.pmod(F.shiftright(address, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]
        return F.when(address < 1 << 32, F.concat_ws(".", *parts))

    values = F.transform(F.split(F.regexp_replace(F.lower(name), r"\.$", ""), r"\."), value)
    return F.when(name.rlike(rf"^{number}(?:\.{number}){{0,3}}\.?$"), F.coalesce(let(let(values, total), dotted), name)).otherwise(name)


def blocked_host(name: Column) -> Column:
    bare = let(F.regexp_replace(name, r"^\[|\]$", ""), numeric_host)
    blocked = let(bare, lambda x: ~F.coalesce(safe_ipv4(x), safe_ipv6(x), F.lit(True)))
    return (name == "localhost") | name.endswith(".localhost") | F.coalesce(blocked, F.lit(False))


def source_struct(repository: Column, branch: Column, path: Column) -> Column:
    raw = F.concat(F.lit(_RAW), repository, F.lit("/"), branch, F.lit("/"), path)
    return F.struct(repository.alias("repository"), branch.alias("branch"), path.alias("path"), raw.alias("raw_url"))


def github_source(url: Column) -> Column:
    pattern = r"(?i)^https?://github\.com/([^/]+)/([^/]+)/(?:edit|blob)/([^/]+)/(.+)$"
    path = F.regexp_extract(F.regexp_extract(url, pattern, 4), "^([^?#]*)", 1)
    repository = F.concat(F.regexp_extract(url, pattern, 1), F.lit("/"), F.regexp_extract(url, pattern, 2))
    return F.when(url.rlike(pattern) & (path != "") & ~path.contains(".."), source_struct(repository, F.regexp_extract(url, pattern, 3), path))


def node_source(url: Column) -> Column:
    pattern = r"(?i)^https?://nodejs\.org/(?:[a-z-]+/)?(?:docs/)?(?:latest(?:-v\d+\.x)?/)?api/([a-z_]+)\.html"
    path = F.concat(F.lit("doc/api/"), F.regexp_extract(url, pattern, 1), F.lit(".md"))
    return F.when(url.rlike(pattern), source_struct(F.lit("nodejs/node"), F.lit("main"), path))


def mdn_source(url: Column) -> Column:
    pattern = r"^https?://developer\.mozilla\.org/([a-zA-Z-]+)/docs/(.+?)/?$"
    slug = F.lower(F.regexp_extract(F.regexp_extract(url, pattern, 2), "^([^?#]*)", 1))
    path = F.concat(F.lit("files/"), F.lower(F.regexp_extract(url, pattern, 1)), F.lit("/"), slug, F.lit("/index.md"))
    return F.when(url.rlike(pattern) & ~slug.contains(".."), source_struct(F.lit("mdn/content"), F.lit("main"), path))


def map_source(url: Column) -> Column:
    return F.coalesce(node_source(url), mdn_source(url))


def route_markdown(url: Column) -> Column:
    """The .md route beside a page, or null if it is one."""
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    path = F.regexp_replace(F.when(path.endswith("/"), F.concat(path, F.lit("index"))).otherwise(path), r"\.html$", "")
    return F.when(~path.endswith(".md") & (host(url) != ""), F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, F.lit(".md")))


def llms_candidates(url: Column, advertised: Column) -> Column:
    """Places of an llms.txt: advertised ones, the origin, the first path segment; first occurrences in order."""
    origin = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)))
    first = F.regexp_extract(part(url, 3), "^/*([^/]+)", 1)
    own = F.array(F.concat(origin, F.lit("/llms.txt")), F.when(first != "", F.concat(origin, F.lit("/"), first, F.lit("/llms.txt"))))
    return F.array_distinct(F.array_compact(F.concat(advertised, own)))


def canonical_asset(url: Column) -> Column:
    """The CDN's version segment as a placeholder, if it is a UUID and `images` is in the path."""
    segment = r"[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
    pattern = rf"(?i)^(https?://{re.escape(_CDN)}/+[^/?#]+/+){segment}(?=/)"
    images = F.array_contains(F.split(part(url, 3), "/"), "images")
    return F.when((host(url) == _CDN) & images, F.regexp_replace(url, pattern, "$1__asset_version__")).otherwise(url)


def same_host(a: Column, b: Column) -> Column:
    return F.coalesce((host(a) == host(b)) & (host(a) != ""), F.lit(False))
