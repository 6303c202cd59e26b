"""Addresses matched with a table of networks: the longest prefix wins.

Networks and addresses become texts of bits, IPv4 and IPv6 apart. An address is looked up once
for each prefix length that the table has (at most 33 + 129), as an equi-join on the prefix;
of the networks found the one with the longest prefix holds. The table of networks may be as
large as the addresses: nothing is broadcast by plan, and no range is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.core import col, join_facts, let, one_per_key
from pageloom.functions.ips import dotted_to_long, ipv6_hex
from pageloom.functions.text import strip

#: What a network of the table does to an address: an "allow" inside a blocked one is an exception.
BLOCK, ALLOW = "block", "allow"
_BITS = {"4": 32, "6": 128}


def _bits(value: Column, width: int) -> Column:
    return F.lpad(F.bin(value), width, "0")


def address_bits(ip: Column | str, mapped: bool = False) -> Column:
    """Version and bits of an address, such as ``4:00001010...``; NULL for text that is none.

    ``mapped`` takes an IPv4 address written as IPv6 (``::ffff:1.2.3.4``) for the IPv4 address.
    """
    ip = col(ip)

    def wide(digits: Column) -> Column:
        group = lambda k: _bits(F.conv(F.substring(digits, 4 * k + 1, 4), 16, 10).cast("long"), 16)
        out = F.concat(F.lit("6:"), *[group(k) for k in range(8)])
        if mapped:
            out = F.when(digits.startswith("0" * 20 + "ffff"), F.concat(F.lit("4:"), group(6), group(7))).otherwise(out)
        return out

    v4 = let(dotted_to_long(ip), lambda v: F.concat(F.lit("4:"), _bits(v, 32)))
    return F.when(F.instr(ip, ":") > 0, let(ipv6_hex(ip), wide)).otherwise(v4)


def net_rows(nets: DataFrame) -> DataFrame:
    """``(key, length, version, net, action)`` of ``nets(net)``, one row per prefix.

    ``net`` is an address with or without ``/length``; bits beyond the length don't count, and
    texts that are no network are left out. ``nets`` may have a column ``action``, NULL and none
    being "block". Of rows with one prefix "allow" holds, else the least text.
    """
    action = F.coalesce("action", F.lit(BLOCK)) if "action" in nets.columns else F.lit(BLOCK)
    parts = F.split(strip("net"), "/")
    rows = nets.select("net", action.alias("action"), address_bits(parts[0]).alias("bits"), F.size(parts).alias("n"),
                       F.get(parts, F.lit(1)).alias("tail"))
    version = F.substring("bits", 1, 1)
    most = F.when(version == "4", _BITS["4"]).otherwise(_BITS["6"])
    length = F.when(F.col("n") == 1, most).when((F.col("n") == 2) & F.col("tail").rlike(r"^[0-9]{1,3}$"), F.col("tail").cast("int"))
    rows = rows.where(F.col("bits").isNotNull()).withColumns({"version": version, "length": length}).where(F.col("length") <= most)
    keyed = rows.select(F.expr("left(bits, length + 2)").alias("key"), "length", "version", "net", "action")
    return one_per_key(keyed, "key", F.col("action") != ALLOW)


def with_nets(addresses: DataFrame, nets: DataFrame, ip: str = "ip", mapped: bool = False) -> DataFrame:
    """Add ``net`` and ``action`` of the longest matching network; NULL where none matches.

    Each distinct address is looked up once, however many rows have it.
    """
    table = net_rows(nets)
    # bounded by the lengths there are
    lengths = sorted((r.version, r.length) for r in table.select("version", "length").distinct().collect())
    prefixes = F.array(*[
        F.when(F.col("_bits").startswith(version + ":"), F.expr(f"left(_bits, {length + 2})")) for version, length in lengths
    ]).cast("array<string>")
    distinct = addresses.select(F.col(ip).alias("_ip")).where("_ip is not null").distinct().withColumn("_bits", address_bits("_ip", mapped))
    tried = distinct.select("_ip", F.explode(F.array_compact(prefixes)).alias("key"))
    found = join_facts(tried, table, "key", "inner").groupBy("_ip").agg(F.max_by(F.struct("net", "action"), "length").alias("_net"))
    joined = join_facts(addresses.withColumn("_ip", F.col(ip)), found, "_ip")
    return joined.withColumns({"net": F.col("_net.net"), "action": F.col("_net.action")}).drop("_ip", "_net")


def with_blocked(addresses: DataFrame, nets: DataFrame, ip: str = "ip", mapped: bool = False) -> DataFrame:
    """Add ``blocked``: the longest network blocks the address, or the text is no address."""
    rows = with_nets(addresses, nets, ip, mapped)
    known = address_bits(ip).isNotNull()
    return rows.withColumn("blocked", ~known | F.coalesce(F.col("action") == BLOCK, F.lit(False))).drop("net", "action")
