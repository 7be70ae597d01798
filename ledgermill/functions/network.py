"""Addresses as numbers, and which of them are public."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

# IPv4 blocks that are private, loopback, link-local, reserved or for documentation.
NOT_PUBLIC = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
)
# Addresses inside 192.0.0.0/24 that are global all the same.
PUBLIC_WITHIN = ("192.0.0.9/32", "192.0.0.10/32")


def cidr_bounds(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def ip_to_long(ip: Column) -> Column:
    """The number of an IPv4 address; null for anything else."""
    octet = lambda i: F.regexp_extract(ip, IPV4, i).cast("long")
    number = ((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4)
    return F.when(ip.rlike(IPV4), number)


def is_public(number: Column) -> Column:
    """Whether an IPv4 number is outside all blocks that are not public."""
    within = lambda blocks: F.lit(False) if not blocks else _any(number, blocks)
    return F.coalesce(number.isNotNull() & (~within(NOT_PUBLIC) | within(PUBLIC_WITHIN)), F.lit(False))


def _any(number: Column, blocks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for block in blocks:
        low, high = cidr_bounds(block)
        out = out | number.between(low, high)
    return out


# IPv6 blocks that are private, reserved, link-local, for documentation or unassigned.
NOT_PUBLIC_6 = (
    "::/8",
    "100::/8",
    "200::/7",
    "400::/6",
    "800::/5",
    "1000::/4",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "3fff::/20",
    "4000::/3",
    "6000::/3",
    "8000::/3",
    "a000::/3",
    "c000::/3",
    "e000::/4",
    "f000::/5",
    "f800::/6",
    "fc00::/7",
    "fe00::/9",
    "fe80::/10",
)
# Blocks inside 2001::/23 that are global all the same.
PUBLIC_WITHIN_6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")

_GROUP = "^[0-9a-f]{1,4}$"


def _let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _groups(half: Column) -> Column:
    return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))


def _long(hex16: Column) -> Column:
    """16 hexadecimal digits as the long with those bits."""
    part = lambda at: F.conv(F.substring(hex16, at, 8), 16, 10).cast("long")
    return F.shiftleft(part(1), 32).bitwiseOR(part(9))


def ip_key(ip: Column) -> Column:
    """struct(version, hi, lo) of an address in text, its 128 bits as two longs; null for anything else.

    IPv4 addresses, and those mapped into IPv6, have version 4, hi 0 and their number as lo. IPv6 may be shortened by
    ``::``, in either case, with a dotted tail; zones are not taken.
    """
    zero = F.lit(0).cast("long")
    key = lambda version, hi, lo: F.struct(F.lit(version).alias("version"), hi.alias("hi"), lo.alias("lo"))
    padded = lambda groups: F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")

    def without_tail(text: Column) -> Column:
        words = lambda tail: F.lower(F.concat(F.hex(F.shiftright(tail, 16)), F.lit(":"), F.hex(tail.bitwiseAND(F.lit(0xFFFF).cast("long")))))
        return F.when(F.contains(text, F.lit(".")), F.concat(F.regexp_replace(text, r"[^:]*$", ""), _let(ip_to_long(F.regexp_extract(text, r"([^:]*)$", 1)), words))).otherwise(text)

    def parsed(text: Column) -> Column:
        halves = F.split(text, "::", -1)
        return _let(F.struct(F.size(halves).alias("n"), _groups(F.get(halves, F.lit(0))).alias("left"), F.coalesce(_groups(F.get(halves, F.lit(1))), F.array().cast("array<string>")).alias("right")), filled)

    def filled(h: Column) -> Column:
        count = F.size(h["left"]) + F.size(h["right"])
        shape = F.when(h["n"] == 1, count == 8).when(h["n"] == 2, count <= 7).otherwise(False)
        valid = shape & F.forall(F.concat(h["left"], h["right"]), lambda g: g.rlike(_GROUP))
        return F.when(valid, _let(F.concat(padded(h["left"]), F.repeat(F.lit("0000"), 8 - count), padded(h["right"])), six))

    def six(digits: Column) -> Column:
        mapped = F.substring(digits, 1, 24) == "0" * 20 + "ffff"
        return F.when(mapped, key(4, zero, F.conv(F.substring(digits, 25, 8), 16, 10).cast("long"))).otherwise(key(6, _long(F.substring(digits, 1, 16)), _long(F.substring(digits, 17, 16))))

    four = _let(ip_to_long(ip), lambda n: F.when(n.isNotNull(), key(4, zero, n)))
    return F.when(F.contains(ip, F.lit(":")), _let(F.lower(ip), lambda text: _let(without_tail(text), parsed))).otherwise(four)


def masked(version: Column, hi: Column, lo: Column, prefix: Column) -> tuple[Column, Column]:
    """(hi, lo) of a key cut to its leading ``prefix`` bits."""
    ones = lambda n: F.when(n <= 0, F.lit(0).cast("long")).when(n >= 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - n).cast("int")))
    low = F.when(version == 4, ones(prefix + 32)).otherwise(ones(prefix - 64))
    return F.when(version == 4, hi).otherwise(hi.bitwiseAND(ones(prefix))), lo.bitwiseAND(low)


def _within_6(hi: Column, lo: Column, blocks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for block in blocks:
        net = ipaddress.ip_network(block)
        words = [int(net.network_address) >> 64, int(net.network_address) & (2**64 - 1)]
        signed = [w - 2**64 if w >= 2**63 else w for w in words]
        cut = masked(F.lit(6), hi, lo, F.lit(net.prefixlen))
        out = out | ((cut[0] == F.lit(signed[0]).cast("long")) & (cut[1] == F.lit(signed[1]).cast("long")))
    return out


def is_public_key(key: Column) -> Column:
    """Whether the address of an ``ip_key`` is public; false for null."""
    six = lambda k: ~_within_6(k["hi"], k["lo"], NOT_PUBLIC_6) | _within_6(k["hi"], k["lo"], PUBLIC_WITHIN_6)
    return F.coalesce(_let(key, lambda k: F.when(k["version"] == 4, is_public(k["lo"])).otherwise(six(k))), F.lit(False))
