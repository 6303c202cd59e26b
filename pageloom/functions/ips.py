"""IP address expressions: literal forms, expansion, blocked networks."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, functions as F

from pageloom.functions.core import col, let

# Networks that must not be reached.
BLOCKED_NETWORKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "100.64.0.0/10", "169.254.0.0/16",
    "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::1/128", "fc00::/7", "fe80::/10",
]

_OCTET = r"(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_DOTTED = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def dotted_to_long(ip: Column) -> Column:
    """Value of four decimal octets; NULL for any other text."""
    value = F.aggregate(
        F.split(ip, r"\."), F.lit(0).cast("long"), lambda acc, octet: acc * 256 + octet.cast("long")
    )
    return F.when(ip.rlike(_DOTTED), value)


def ipv4_literal(host: Column | str) -> Column:
    """Value of a host written as an IPv4 address in any form a resolver accepts.

    One to four parts, each decimal, octal (leading 0) or hex (leading 0x); the last part
    fills the bytes that are left. NULL when the host is no such literal.
    """
    host = F.lower(col(host))

    def number(part: Column) -> Column:
        return (
            F.when(part.rlike(r"^0x[0-9a-f]{1,12}$"), F.conv(F.substring(part, 3, 12), 16, 10))
            .when(part.rlike(r"^0[0-7]{1,16}$"), F.conv(part, 8, 10))
            .when(part.rlike(r"^(?:0|[1-9][0-9]{0,11})$"), part)
            .try_cast("long")
        )

    def value(nums: Column) -> Column:
        n = F.size(nums)
        last = F.element_at(nums, -1)
        head = F.slice(nums, 1, n - 1)
        room = F.element_at(F.array(*[F.lit(256 ** k) for k in (4, 3, 2, 1)]), n)
        high = F.aggregate(head, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
        ok = ~F.exists(nums, lambda x: x.isNull()) & ~F.exists(head, lambda x: x > 255) & (last < room)
        return F.when(ok, high * room + last)

    shape = r"^[0-9a-fx]+(?:\.[0-9a-fx]+){0,3}$"
    return F.when(
        host.rlike(shape) & host.rlike(r"^[0-9]"), let(F.transform(F.split(host, r"\."), number), value)
    )


def ipv4_text(value: Column) -> Column:
    """Dotted form of a value; NULL stays NULL."""
    octets = [F.shiftright(value, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
    return F.concat(octets[0], *[x for octet in octets[1:] for x in (F.lit("."), octet)])


def looks_like_ipv6(host: Column) -> Column:
    return F.instr(host, ":") > 0


def ipv6_hex(ip: Column | str) -> Column:
    """32 hex digits of an IPv6 address, scope id dropped; NULL when it is none."""
    text = F.lower(col(ip))
    scope_ok = (F.instr(text, "%") == 0) | text.rlike(r"^[^%]+%[^%]+$")
    bare = F.regexp_extract(text, r"^([^%]*)", 1)
    tail = F.regexp_extract(bare, r":([0-9.]*\.[0-9.]*)$", 1)

    def widen(t: Column) -> Column:
        def with_pair(v4: Column) -> Column:
            high, low = F.shiftright(v4, 16), v4.bitwiseAND(65535)
            head = F.regexp_replace(bare, r"[0-9.]*\.[0-9.]*$", "")
            return F.concat(head, F.lower(F.hex(high)), F.lit(":"), F.lower(F.hex(low)))

        return F.when(t == "", bare).otherwise(let(dotted_to_long(t), with_pair))

    def groups(part: Column) -> Column:
        return F.filter(F.split(F.coalesce(part, F.lit("")), ":", -1), lambda g: (g != "") | (part != ""))

    def fill(halves: Column) -> Column:
        short = F.size(halves["h"]) == 2
        gap = F.lit(8) - F.size(halves["l"]) - F.size(halves["r"])
        zeros = F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0)))
        whole = F.concat(halves["l"], zeros, halves["r"])
        return F.when(F.when(short, gap >= 1).otherwise(gap == 0), whole)

    def expand(a: Column) -> Column:
        halves = let(
            F.split(a, "::", 2),
            lambda h: F.struct(
                h.alias("h"), groups(F.get(h, F.lit(0))).alias("l"),
                F.coalesce(groups(F.get(h, F.lit(1))), F.array().cast("array<string>")).alias("r"),
            ),
        )
        digits = lambda gs: F.when(
            F.forall(gs, lambda g: g.rlike("^[0-9a-f]{1,4}$")),
            F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), ""),
        )
        return let(let(halves, fill), digits)

    return F.when((F.instr(text, ":") > 0) & scope_ok, let(let(tail, widen), expand))


def in_ipv4_nets(value: Column) -> Column:
    """Whether the value of an IPv4 address lies in a blocked network."""
    nets = [n for n in map(ipaddress.ip_network, BLOCKED_NETWORKS) if n.version == 4]
    tests = [value.between(int(n.network_address), int(n.broadcast_address)) for n in nets]
    return reduce(lambda a, b: a | b, tests)


def _in_ipv6_nets(digits: Column) -> Column:
    nets = [n for n in map(ipaddress.ip_network, BLOCKED_NETWORKS) if n.version == 6]
    tests = [
        digits.between(f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}") for n in nets
    ]
    return reduce(lambda a, b: a | b, tests)


def ip_blocked(ip: Column | str, strict: bool = False) -> Column:
    """True for addresses in a blocked network and for text that is no address.

    The eighteen networks are constants, so the test is a chain of range comparisons
    inside the scan stage; no join. ``strict`` also looks through IPv4-mapped IPv6.
    """
    ip = col(ip)

    def v6(digits: Column) -> Column:
        hit = _in_ipv6_nets(digits)
        if strict:
            mapped = F.conv(F.substring(digits, 25, 8), 16, 10).cast("long")
            hit = F.when(digits.startswith("0" * 20 + "ffff"), let(mapped, in_ipv4_nets)).otherwise(hit)
        return F.coalesce(hit, F.lit(True))

    v4 = F.coalesce(let(dotted_to_long(ip), in_ipv4_nets), F.lit(True))
    return F.when(F.coalesce(F.instr(ip, ":") > 0, F.lit(False)), let(ipv6_hex(ip), v6)).otherwise(v4)
