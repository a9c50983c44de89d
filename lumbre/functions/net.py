"""Addresses, user agents and locations."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

from lumbre.functions.nested import let

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_H = r"[0-9A-Fa-f]{1,4}"
IPV6 = (rf"(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,7}}:|(?:{_H}:){{1,6}}:{_H}|(?:{_H}:){{1,5}}(?::{_H}){{1,2}}"
        rf"|(?:{_H}:){{1,4}}(?::{_H}){{1,3}}|(?:{_H}:){{1,3}}(?::{_H}){{1,4}}|(?:{_H}:){{1,2}}(?::{_H}){{1,5}}"
        rf"|{_H}:(?::{_H}){{1,6}}|:(?:(?::{_H}){{1,7}}|:))")


_V4_TAIL = rf"(?:::(?:(?:{_H}:){{0,5}})|(?:{_H}:){{6}}|(?:{_H}:){{1,5}}:)"
IPV6_WITH_V4 = rf"{_V4_TAIL}{IPV4}"
#: the first twelve bytes of an IPv4 address among the 128-bit ones
MAPPED = "00000000000000000000ffff"


def is_ip(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(rf"^(?:{IPV4}|{IPV6}|{IPV6_WITH_V4})$"), F.lit(False))


def address_key(c: Column) -> Column:
    """The address as 16 bytes that sort as addresses do, NULL if it is none; IPv4 and its mapped spellings are the same key."""
    def packed(text: Column) -> Column:
        # four octets as eight digits; an address of eight groups as 32
        octets = lambda v4: F.array_join(F.transform(F.split(v4, r"\."), lambda o: F.lpad(F.hex(o.cast("bigint")), 2, "0")), "")
        tail = F.substring_index(text, ":", -1)
        unfolded = F.when(tail.contains("."), let(octets(tail), lambda d: F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail)), F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4)))).otherwise(text)
        groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")

        def filled(halves: Column) -> Column:
            left, right = halves[0], halves[1]
            zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right)))
            return F.array_join(F.transform(F.concat(left, F.when(F.size(halves) > 1, zeros).otherwise(F.array().cast("array<string>")), right), lambda g: F.lpad(g, 4, "0")), "")
        parts = let(F.split(unfolded, "::"), lambda h: F.array(groups(F.coalesce(F.get(h, F.lit(0)), F.lit(""))), groups(F.coalesce(F.get(h, F.lit(1)), F.lit("")))))
        return F.when(text.contains(":"), let(parts, filled)).otherwise(F.concat(F.lit(MAPPED), octets(text)))

    text = F.lower(F.trim(c))
    return let(F.when(is_ip(c), text), lambda t: let(packed(t), lambda h: F.when(F.length(h) == 32, F.unhex(h))))


def ipv4_number(c: Column) -> Column:
    """The address as a 32-bit number in a bigint, NULL if it is not one."""
    parts = F.split(F.when(c.rlike(rf"^{IPV4}$"), c), r"\.")
    return sum((parts[i].cast("bigint") * F.lit(256 ** (3 - i)) for i in range(1, 4)),
               parts[0].cast("bigint") * F.lit(256 ** 3))


def in_network(c: Column, *networks: str) -> Column:
    """The address lies in any of the CIDR blocks, IPv4 or IPv6; a mapped address counts as the IPv4 one that it holds."""
    nets = [ipaddress.ip_network(text) for text in networks]
    if all(n.version == 4 for n in nets):
        number = F.coalesce(ipv4_number(c), ipv4_number(F.regexp_extract(F.lower(F.trim(c)), rf"^::ffff:({IPV4})$", 1)))
        hits = [number.between(int(n.network_address), int(n.broadcast_address)) for n in nets]
    else:
        key = address_key(c)
        bound = lambda a: F.lit(bytes.fromhex(MAPPED) + a.packed if a.version == 4 else a.packed)
        hits = [key.between(bound(n.network_address), bound(n.broadcast_address)) for n in nets]
    hit = F.lit(False)
    for h in hits:
        hit = hit | h
    return F.coalesce(hit, F.lit(False))


# Fixed values, tried in order: browser and system names of a user agent text.
_BROWSERS = (("Edge", r"Edg(?:e|A|iOS)?/"), ("Opera", r"OPR/|Opera"), ("Firefox", r"Firefox/|FxiOS/"),
             ("Chrome", r"Chrome/|CriOS/"), ("Safari", r"Version/.*Safari/"), ("IE", r"MSIE |Trident/"),
             ("curl", r"^curl/"), ("bot", r"(?i)bot|crawler|spider"))
_SYSTEMS = (("Android", r"Android"), ("iOS", r"iPhone|iPad|iPod"), ("Windows", r"Windows"),
            ("Mac OS", r"Macintosh|Mac OS X"), ("Linux", r"Linux|X11"))


def _first_rule(c: Column, rules) -> Column:
    name, rx = rules[0]
    chain = F.when(c.rlike(rx), F.lit(name))
    for name, rx in rules[1:]:
        chain = chain.when(c.rlike(rx), F.lit(name))
    return chain.otherwise(F.lit("Other"))


def browser(c: Column) -> Column:
    return _first_rule(c, _BROWSERS)


def system(c: Column) -> Column:
    return _first_rule(c, _SYSTEMS)


def geo_point(lat: Column, lon: Column) -> Column:
    """A location when both values are numbers in range and not (0, 0)."""
    a, b = lat.try_cast("double"), lon.try_cast("double")
    usable = (F.abs(a) <= 90) & (F.abs(b) <= 180) & ~((a == 0) & (b == 0))
    return F.when(usable, F.struct(a.alias("lat"), b.alias("lon")))


def geo_point_from_text(c: Column) -> Column:
    """The same from a single ``"lat,lon"`` text."""
    rx = r"^\s*(-?\d{1,3}(?:\.\d+)?)\s*,\s*(-?\d{1,3}(?:\.\d+)?)\s*$"
    ok = c.rlike(rx)
    return geo_point(F.when(ok, F.regexp_extract(c, rx, 1)), F.when(ok, F.regexp_extract(c, rx, 2)))


_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lon: Column, precision: int = 3) -> Column:
    """Geohash cell: the two coordinates as fixed-width integers, bits interleaved (longitude first)."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2

    def cell(value: Column, low: float, high: float, width: int) -> Column:
        step = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(float(2 ** width)))
        return F.least(F.greatest(step, F.lit(0)), F.lit(2 ** width - 1)).cast("bigint")
    x, y = cell(lon, -180.0, 180.0, lon_bits), cell(lat, -90.0, 90.0, lat_bits)
    out = []
    for char in range(precision):
        value = F.lit(0).cast("bigint")
        for b in range(5):
            i = char * 5 + b
            source, pos = (x, lon_bits - 1 - i // 2) if i % 2 == 0 else (y, lat_bits - 1 - i // 2)
            value = value + F.shiftright(source, pos).bitwiseAND(F.lit(1)) * F.lit(2 ** (4 - b))
        out.append(F.substring(F.lit(_BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*out)
