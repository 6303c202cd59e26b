"""URL expressions: parts, domain, joining, href tests, safety verdict."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pageloom.functions.core import col, let
from pageloom.functions.ips import in_ipv4_nets, ip_blocked, ipv4_literal, ipv4_text, ipv6_hex, looks_like_ipv6
from pageloom.functions.text import strip

# Schemes and host names with a meaning of their own.
ALLOWED_SCHEMES = ["http", "https"]
LOCAL_NAMES = ["localhost", "localhost.localdomain", "local"]
URL_ATTRIBUTES = ["href", "src", "action", "data-src", "data-url"]
HIERARCHICAL = [
    "", "file", "ftp", "gopher", "http", "https", "imap", "mms", "nntp", "prospero",
    "rtsp", "rtsps", "rtspu", "sftp", "shttp", "svn", "svn+ssh", "wais", "ws", "wss",
]

# The reasons given with a verdict.
REASON_SAFE = "URL is safe."
REASON_EMPTY = "URL must be a non-empty string."
REASON_PARSE = "Failed to parse URL: Invalid IPv6 URL"
REASON_SCHEME = "Disallowed scheme '%s'. Only http and https are allowed."
REASON_NO_HOST = "URL does not contain a valid hostname."
REASON_LOCAL = "Access to localhost hostnames is forbidden."
REASON_UNRESOLVED = "Could not resolve hostname '%s'."
REASON_BLOCKED = "Hostname '%s' resolved to blocked/private IP '%s'."


def _tidy(url: Column) -> Column:
    """Leading control characters and blanks go, and line breaks and tabs anywhere."""
    return F.translate(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "\t\r\n", "")


def split_url(url: Column | str) -> Column:
    """struct(scheme, netloc, path, params, query, fragment), all strings, '' where absent."""
    def parts(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
        rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
        path = F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1)
        return F.struct(
            scheme.alias("scheme"),
            F.regexp_extract(rest, r"^//([^/?#]*)", 1).alias("netloc"),
            F.regexp_extract(path, r"^((?:.*/)?[^/;]*)", 1).alias("path"),
            F.regexp_extract(path, r"^(?:.*/)?[^/;]*;([^/]*)$", 1).alias("params"),
            F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1).alias("query"),
            F.regexp_extract(rest, r"^[^#]*#((?s).*)", 1).alias("fragment"),
        )
    return let(_tidy(col(url)), parts)


def domain(url: Column | str) -> Column:
    """Network location in lower case; port and user info stay."""
    return F.lower(F.regexp_extract(_tidy(col(url)), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def hostname(netloc: Column) -> Column:
    """Host of a network location: no user info, no port, no brackets; '' where absent."""
    info = F.regexp_replace(netloc, r"^.*@", "")
    return F.lower(
        F.when(F.instr(info, "[") > 0, F.regexp_extract(info, r"\[([^\]]*)", 1))
        .otherwise(F.regexp_extract(info, r"^([^:]*)", 1))
    )


def _merge_dots(segments: Column) -> Column:
    """Apply '.' and '..' segments; '..' above the root is dropped."""
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.array_append(acc, seg)),
    )
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)


def _merge_paths(base_path: Column, path: Column) -> Column:
    folder = F.split(F.regexp_replace(base_path, r"[^/]+$", ""), "/")
    base_parts = F.when(base_path.endswith("/") | (base_path == ""), F.split(base_path, "/")).otherwise(
        F.slice(folder, 1, F.size(folder) - 1)
    )
    joined = F.concat(base_parts, F.split(path, "/"))
    inner = F.filter(F.slice(joined, 2, F.greatest(F.size(joined) - 2, F.lit(0))), lambda s: s != "")
    relative = F.when(
        F.size(joined) > 1,
        F.concat(F.slice(joined, 1, 1), inner, F.slice(joined, -1, 1)),
    ).otherwise(joined)
    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(relative)
    merged = let(segments, lambda s: F.array_join(_merge_dots(s), "/"))
    return F.when(merged == "", F.lit("/")).otherwise(merged)


def _build(scheme: Column, netloc: Column, path: Column, params: Column, query: Column, fragment: Column) -> Column:
    full = F.concat(path, F.when(params != "", F.concat(F.lit(";"), params)).otherwise(F.lit("")))
    rooted = F.when((full != "") & ~full.startswith("/"), F.concat(F.lit("/"), full)).otherwise(full)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(netloc != "", F.concat(F.lit("//"), netloc, rooted)).otherwise(full),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def unsplit_url(p: Column) -> Column:
    """Text of a struct made by ``split_url``."""
    return _build(p.scheme, p.netloc, p.path, p.params, p.query, p.fragment)


def _join_parts(b: Column, r: Column, ref: Column) -> Column:
    """Join from split parts; ``r`` is the split reference, its scheme '' when relative."""
    scheme = F.when(r.scheme == "", b.scheme).otherwise(r.scheme)
    same_page = (r.path == "") & (r.params == "")
    return (
        F.when((scheme != b.scheme) | ~scheme.isin(HIERARCHICAL), ref)
        .when(r.netloc != "", _build(scheme, r.netloc, r.path, r.params, r.query, r.fragment))
        .when(
            same_page,
            _build(scheme, b.netloc, b.path, b.params,
                   F.when(r.query == "", b.query).otherwise(r.query), r.fragment),
        )
        .otherwise(_build(scheme, b.netloc, _merge_paths(b.path, r.path), r.params, r.query, r.fragment))
    )


def join_url(base: Column | str, ref: Column | str) -> Column:
    """Absolute form of ``ref`` seen from ``base``. Plain root paths take a short way."""
    base = col(base)

    def joined(ref: Column) -> Column:
        plain_root = ref.rlike(r"^/[A-Za-z0-9_\-]+$") & base.rlike(r"^https?://[^/?#\x00-\x20]+")
        return (
            F.when(F.coalesce(base, F.lit("")) == "", ref)
            .when(F.coalesce(ref, F.lit("")) == "", base)
            .when(plain_root, F.concat(F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), ref))
            .otherwise(let(split_url(base), lambda b: let(split_url(ref), lambda r: _join_parts(b, r, ref))))
        )

    return let(col(ref), joined)


def valid_href(href: Column | str) -> Column:
    """False for missing or empty links, in-page anchors and pseudo protocols."""
    href = col(href)
    h = F.lower(strip(href))
    refused = h.startswith("#") | h.startswith("javascript:") | h.startswith("mailto:")
    return F.coalesce((href != "") & ~refused, F.lit(False))


def url_host(url: Column | str) -> Column:
    """Host used for the address lookup."""
    return hostname(split_url(strip(col(url))).netloc)


def _bad_brackets(netloc: Column) -> Column:
    """Brackets that don't hold an IPv6 or IPvFuture address, with a port at most after them."""
    place = F.regexp_extract(netloc, r"([^@]*)$", 1)
    inside = F.regexp_extract(place, r"^\[([^\]]*)\](:.*)?$", 1)
    future = inside.rlike(r"^v[0-9a-fA-F]+\..+$")
    address = ipv6_hex(inside).isNotNull()
    any_bracket = F.instr(netloc, "[") + F.instr(netloc, "]") > 0
    return any_bracket & ~(future | F.coalesce(address, F.lit(False)))


def literal_address(host: Column) -> Column:
    """Address of a host that is one itself, in its usual form; NULL for names."""
    return F.when(looks_like_ipv6(host), host).otherwise(ipv4_text(ipv4_literal(host)))


def url_reason(
    url: Column | str, resolved: Column, blocked: Column, strict: bool = False, literals_looked_up: bool = False
) -> Column:
    """Reason of the safety verdict, checks in order.

    ``resolved``: the host was found in the address table; ``blocked``: one blocked address
    of it or NULL. Hosts that are addresses themselves need neither, unless they were looked
    up like the others.
    """
    url = col(url)

    def verdict(p: Column) -> Column:
        netloc = p.netloc

        def by_host(host: Column) -> Column:
            def as_address(value: Column) -> Column:
                address = F.when(looks_like_ipv6(host), host).otherwise(ipv4_text(value))
                if literals_looked_up:
                    hit = blocked.isNotNull()
                else:
                    hit = F.when(looks_like_ipv6(host), ip_blocked(host, strict)).otherwise(in_ipv4_nets(value))
                return F.when(hit, F.format_string(REASON_BLOCKED, host, address)).otherwise(REASON_SAFE)

            by_name = (
                F.when(~F.coalesce(resolved, F.lit(False)), F.format_string(REASON_UNRESOLVED, host))
                .when(blocked.isNotNull(), F.format_string(REASON_BLOCKED, host, blocked))
                .otherwise(F.lit(REASON_SAFE))
            )
            return (
                F.when(host == "", F.lit(REASON_NO_HOST))
                .when(host.isin(LOCAL_NAMES), F.lit(REASON_LOCAL))
                .otherwise(let(
                    ipv4_literal(host),
                    lambda v: F.when(v.isNotNull() | looks_like_ipv6(host), as_address(v)).otherwise(by_name),
                ))
            )

        return (
            F.when(_bad_brackets(netloc), F.lit(REASON_PARSE))
            .when(~p.scheme.isin(ALLOWED_SCHEMES), F.format_string(REASON_SCHEME, p.scheme))
            .otherwise(let(hostname(netloc), by_host))
        )

    return F.when(F.coalesce(url, F.lit("")) == "", F.lit(REASON_EMPTY)).otherwise(
        let(split_url(strip(url)), verdict)
    )
