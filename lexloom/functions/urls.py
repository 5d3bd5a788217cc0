"""Column expressions auditing outbound URLs.

Hosts are read the way a browser reads them before they are judged: blanks around
a URL and line ends inside it do not count, a backslash is a slash, escapes are
decoded, and a host that ends in a number is an IPv4 address of one to four
parts, each decimal, octal or hexadecimal. IPv6 addresses are expanded to their
eight groups.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = _SCHEME + r"[/\\]*([^/?#\\]*)"
_NUMBER = r"^(?:0[xX][0-9a-fA-F]*|[0-9]+)$"
_INVALID = "not a valid URL"


def _plain(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_plain(url), _SCHEME, 1))


def host(url: Column) -> Column:
    """Lower-case host without credentials, brackets, port and the dot at its end; null if its escapes are broken."""
    authority = F.regexp_extract(_plain(url), _AUTHORITY, 2)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    decoded = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    unescaped = F.when(F.contains(bare, F.lit("%")), decoded).otherwise(bare)
    return F.regexp_replace(F.regexp_replace(F.lower(unescaped), r"^\[|\]$", ""), r"\.$", "")


def _number(part: Column) -> Column:
    """Value of one part of an IPv4 address; null if it is none or beyond 2^32."""
    digits = F.regexp_replace(part, r"^0[xX]", "")
    value = (
        F.when(part.rlike(r"^0[xX]$"), "0")
        .when(part.rlike(r"^0[xX][0-9a-fA-F]{1,12}$"), F.conv(digits, 16, 10))
        .when(part.rlike(r"^0[0-7]{1,16}$"), F.conv(part, 8, 10))
        .when(part.rlike(r"^(?:0|[1-9]\d{0,14})$"), part)
    )
    return value.try_cast("long")


def ipv4(h: Column) -> Column:
    """The address as one number: -1 for a host that is no number, null for a broken address."""

    def total(parts: Column) -> Column:
        n = F.size(parts)
        last = F.element_at(parts, -1)
        heads = F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0)))
        whole = F.aggregate(heads, F.lit(0).cast("long"), lambda s, v: F.when(v <= 255, s * 256 + v))
        shift = F.lit(256.0) ** (5 - n)
        return F.when((n <= 4) & (last < shift), (whole * shift).cast("long") + last)

    ends_in_number = F.element_at(F.split(h, r"\."), -1).rlike(_NUMBER)
    value = let(F.transform(F.split(h, r"\."), _number), total)
    return F.when(ends_in_number, value).otherwise(F.lit(-1).cast("long"))


def _refused_quad(a: Column, b: Column) -> Column:
    return (
        a.isin(0, 10, 127)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
    )


def _refused_ipv4(address: Column) -> Column:
    high = F.floor(address / 16777216).cast("int")
    return (address >= 0) & _refused_quad(high, (F.floor(address / 65536) % 256).cast("int"))


def ipv6_groups(h: Column) -> Column:
    """The eight groups of an IPv6 address as numbers; null if it is none."""
    tail = r"^(.*:)(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    quad = [F.regexp_extract(h, tail, i).try_cast("int") for i in (2, 3, 4, 5)]
    hexed = F.concat(
        F.regexp_extract(h, tail, 1), F.hex(quad[0] * 256 + quad[1]), F.lit(":"), F.hex(quad[2] * 256 + quad[3])
    )
    body = F.when(h.rlike(tail) & (F.greatest(*quad) <= 255), F.lower(hexed)).otherwise(h)

    def expand(halves: Column) -> Column:
        def groups(half: Column) -> Column:
            return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

        left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        missing = 8 - F.size(left) - F.size(right)
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        fits = F.when(F.size(halves) == 1, missing == 0).otherwise((F.size(halves) == 2) & (missing >= 1))
        all_groups = F.concat(left, zeros, right)
        valid = fits & F.forall(all_groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(valid, F.transform(all_groups, lambda g: F.conv(g, 16, 10).cast("int")))

    return let(F.split(body, "::"), expand)


def _refused_ipv6(g: Column) -> Column:
    group = [F.get(g, F.lit(i)) for i in range(8)]
    zero_head = F.forall(F.slice(g, 1, 5), lambda v: v == 0)
    inside = _refused_quad(F.floor(group[6] / 256).cast("int"), group[6] % 256)
    return (
        (zero_head & (group[5] == 0) & (group[6] == 0) & group[7].isin(0, 1))
        | (zero_head & (group[5] == 0xFFFF) & inside)
        | group[0].between(0xFE80, 0xFEBF)
        | group[0].between(0xFC00, 0xFDFF)
    )


def refusal(url: Column) -> Column:
    """Why a URL must not be fetched; null for a safe one."""
    return let(F.struct(scheme(url).alias("s"), host(url).alias("h")), lambda u: _refusal(u["s"], u["h"]))


def _refusal(s: Column, h: Column) -> Column:
    reason = F.concat(F.lit("refused: "), h, F.lit(" is a local, private or reserved host"))
    named = (h == "localhost") | F.endswith(h, F.lit(".localhost"))
    v6 = let(ipv6_groups(h), lambda g: F.when(g.isNull(), _INVALID).when(_refused_ipv6(g), reason))
    v4 = let(ipv4(h), lambda a: F.when(a.isNull(), _INVALID).when(_refused_ipv4(a), reason))
    return (
        F.when(s == "", _INVALID)
        .when(~s.isin("http", "https"), F.concat(F.lit("scheme not allowed: "), s))
        .when(h.isNull() | (h == ""), _INVALID)
        .when(named, reason)
        .when(F.contains(h, F.lit(":")), v6)
        .otherwise(v4)
    )
