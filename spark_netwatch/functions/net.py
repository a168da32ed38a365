"""Column functions for packets and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_flags(flags="tcp_flags") -> dict[str, Column]:
    """P5: one 0/1 int column per TCP flag bit."""
    f = _col(flags)
    return {f"is_{name}": (f.bitwiseAND(F.lit(bit)) != 0).cast("int") for name, bit in C.TCP_FLAG_BITS.items()}


def service_flags(port="dst_port") -> dict[str, Column]:
    """Service indicator flags by destination port."""
    p = _col(port)
    return {name: p.isin(ports).cast("int") for name, ports in C.SERVICE_PORTS.items()}


def ip_long(ip="src_ip") -> Column:
    """IPv4 text -> unsigned 32-bit value as bigint; null when not a dotted quad of 0-255."""
    parts = F.split(_col(ip), r"\.")
    valid = _col(ip).rlike(C.IPV4_PATTERN)
    value = F.lit(0).cast("bigint")
    for i in range(4):
        value = value * 256 + F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint")
    return F.when(valid, value)


def subnet24(ip="src_ip") -> Column:
    """``a.b.c.0/24`` of a four-part address, else null."""
    c = _col(ip)
    return F.when(F.size(F.split(c, r"\.")) == 4, F.concat(F.substring_index(c, ".", 3), F.lit(".0/24")))


def is_private(ip="src_ip") -> Column:
    """F22 (library rule): private, loopback or unspecified; invalid text counts as private."""
    def inside(v):
        found = v.isNull()
        for lo, hi in C.PRIVATE_RANGES:
            found = found | v.between(_ip_value(lo), _ip_value(hi))
        return found

    return F.exists(F.array(ip_long(ip)), inside)       # an array of one, so that the address is parsed once


def is_internal_prefix(ip="src_ip") -> Column:
    """F22 (prefix rule used by the playbook): starts with 10., 192.168. or 172."""
    c = _col(ip)
    out = F.lit(False)
    for p in C.PRIVATE_PREFIXES:
        out = out | c.startswith(p)
    return out


def split_endpoint(endpoint) -> tuple[Column, Column]:
    """``ip:port`` split at the first colon."""
    c = _col(endpoint)
    return F.substring_index(c, ":", 1), F.regexp_extract(c, r"^[^:]*:(.*)$", 1)


def _ip_value(text: str) -> int:
    a, b, c, d = (int(x) for x in text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d
