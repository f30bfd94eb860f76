"""IP address columns as native expressions: no Python runs per row."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowhelm.functions.scalar import let

# The IANA special-purpose registries, as networks.
PRIVATE_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
PRIVATE_V4_EXCEPT = ["192.0.0.9/32", "192.0.0.10/32"]
SHARED_V4 = ["100.64.0.0/10"]
PRIVATE_V6 = [
    "::/128", "::1/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16",
    "3fff::/20", "fc00::/7", "fe80::/10",
]
PRIVATE_V6_EXCEPT = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_V4_TAIL = rf":{_OCTET}(\.{_OCTET}){{3}}$"


def is_v4(text: Column) -> Column:
    return F.coalesce(text.rlike(V4_PATTERN), F.lit(False))


def _groups_text(text: Column) -> Column:
    """Lower case, zone cut off, a dotted tail replaced by its two hex groups."""
    plain = F.regexp_replace(F.lower(text), "%[^%]+$", "")

    def tail_as_hex(t: Column) -> Column:
        tail = F.split(F.element_at(F.split(t, ":"), -1), r"\.")
        octet = [F.lpad(F.lower(F.hex(F.get(tail, i).try_cast("long"))), 2, "0") for i in range(4)]
        return F.concat(F.regexp_replace(t, _V4_TAIL, ""), F.lit(":"), octet[0], octet[1], F.lit(":"), octet[2], octet[3])

    return let(plain, lambda t: F.when(t.rlike(_V4_TAIL), tail_as_hex(t)).otherwise(t))


def _well_formed(t: Column) -> Column:
    groups = F.filter(F.split(t, ":"), lambda g: g != "")
    words = t.rlike("^[0-9a-f]{0,4}(:[0-9a-f]{0,4})+$")
    gap = t.contains("::")
    one_gap = gap & ~t.contains(":::") & ~t.rlike("::.*::") & (F.size(groups) <= 7) & ~t.rlike("^:[^:]") & ~t.rlike("[^:]:$")
    return words & (one_gap | (~gap & (F.size(groups) == 8) & t.rlike("^[^:].*[^:]$")))


def v6_digits(text: Column) -> Column:
    """The 32 hex digits of an IPv6 address, which compare like the number; null for anything else."""

    def expand(t: Column) -> Column:
        left = F.filter(F.split(F.get(F.split(t, "::", 2), 0), ":"), lambda g: g != "")
        right = F.coalesce(F.filter(F.split(F.get(F.split(t, "::", 2), 1), ":"), lambda g: g != ""), F.array().cast("array<string>"))
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right)))
        return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), "")

    return F.when(text.contains(":"), let(_groups_text(text), lambda t: F.when(_well_formed(t), expand(t))))


def v4_number(text: Column) -> Column:
    parts = F.split(text, r"\.")
    n = sum((F.get(parts, i).try_cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(is_v4(text), n)


def ip_valid(text: Column) -> Column:
    return F.coalesce(is_v4(text) | v6_digits(text).isNotNull(), F.lit(False))


# The functions below take the parsed forms: ``n`` from v4_number, ``d`` from v6_digits.

def octet(n: Column, i: int) -> Column:
    """The i-th (1..4) octet, -1 when the text is no IPv4 address."""
    return F.coalesce(F.shiftright(n, 32 - 8 * i).bitwiseAND(255).cast("int"), F.lit(-1))


def subnet(n: Column, bits: int) -> Column:
    """Network address of the /8, /16 or /24 as a number, -1 when no IPv4."""
    return F.coalesce(n - F.pmod(n, F.lit(1 << (32 - bits))), F.lit(-1).cast("long"))


def _within(value: Column, nets: list[str], form: str | None) -> Column:
    out = F.lit(False)
    for net in map(ipaddress.ip_network, nets):
        low, high = int(net[0]), int(net[-1])
        out = out | (value.between(format(low, form), format(high, form)) if form else value.between(low, high))
    return out


def _mapped(d: Column) -> Column:
    """The IPv4 number inside an IPv4-mapped IPv6 address."""
    return F.when(d.startswith("0" * 20 + "ffff"), F.conv(F.substring(d, 25, 8), 16, 10).cast("long"))


def is_private(n: Column, d: Column) -> Column:
    four = F.coalesce(n, _mapped(d))
    v4 = _within(four, PRIVATE_V4, None) & ~_within(four, PRIVATE_V4_EXCEPT, None)
    v6 = _within(d, PRIVATE_V6, "032x") & ~_within(d, PRIVATE_V6_EXCEPT, "032x")
    return F.when(four.isNotNull(), v4).when(d.isNotNull(), v6).otherwise(F.lit(False))


def is_global(n: Column, d: Column) -> Column:
    shared = F.coalesce(_within(F.coalesce(n, _mapped(d)), SHARED_V4, None), F.lit(False))
    return (n.isNotNull() | d.isNotNull()) & ~is_private(n, d) & ~shared
