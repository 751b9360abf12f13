"""Scalar expressions over packet columns. All of them are built-in Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

TCP, UDP, ICMP = 6, 17, 1
SYN, RST, ACK, FIN = 0x02, 0x04, 0x10, 0x01


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: str | Column = "ts") -> Column:
    return F.unix_micros(col(ts))


def floor_div(value: Column, n: int | Column) -> Column:
    """Integer quotient rounded down."""
    n = F.lit(n).cast("long") if isinstance(n, int) else n
    return ((value - F.pmod(value, n)) / n).cast("long")


# --- layer presence -------------------------------------------------------------------------------------------------

def is_ip() -> Column:
    return F.col("src_ip").isNotNull()


def is_tcp() -> Column:
    return F.col("ip_proto") == TCP


def is_udp() -> Column:
    return F.col("ip_proto") == UDP


def is_icmp() -> Column:
    return F.col("ip_proto") == ICMP


def is_wlan() -> Column:
    return F.col("wlan_type").isNotNull()


def is_management(subtype: int) -> Column:
    return (F.col("wlan_type") == 0) & (F.col("wlan_subtype") == subtype)


def is_deauth() -> Column:
    return is_management(12)


def is_beacon() -> Column:
    return is_management(8)


def is_probe_request() -> Column:
    return is_management(4)


def has_payload() -> Column:
    return payload_size() > 0


# --- numbers and time -----------------------------------------------------------------------------------------------

def flag(condition: Column) -> Column:
    """Condition as 0/1; unknown counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def ipv4_to_int(ip: str | Column) -> Column:
    """IPv4 text as an integer; null for any other text."""
    octets = F.transform(F.split(col(ip), "[.]"), lambda x: x.try_cast("long"))
    return F.aggregate(octets, F.lit(0).cast("long"), lambda total, octet: total * 256 + octet)


def time_bucket(ts: str | Column = "ts", seconds: int = 1) -> Column:
    return floor_div(micros(ts), seconds * 1_000_000)


def has_bits(flags: str | Column, mask: int) -> Column:
    return col(flags).bitwiseAND(F.lit(mask)) != 0


def saturating(base: float, step: Column, cap: float) -> Column:
    return F.least(F.lit(base) + step, F.lit(cap))


def capped_ratio(n: Column, divisor: int, cap: int = 10) -> Column:
    """``min(n // divisor, cap)`` as an integer."""
    return F.least(F.floor(n / F.lit(divisor)), F.lit(cap)).cast("int")


def any_positive(*columns: str) -> Column:
    return flag(F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in columns]) > 0)


def two_decimals(x: Column) -> Column:
    """Text of a double that is not negative with two decimals, rounded as its binary value rounds, exact halves to even.

    The double is split into two parts whose products with 200 are exact, so the distance to the half way point has the right sign.
    """
    whole = F.floor(x * 100)
    scaled = x * F.lit(134217729.0)
    high = scaled - (scaled - x)
    beyond = (high * 200 - (2 * whole + 1).cast("double")) + (x - high) * 200
    n = whole + F.when((beyond > 0) | ((beyond == 0) & (whole % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def ratio_text(part: Column, whole: Column) -> Column:
    """``part / whole`` with two decimals."""
    return two_decimals((part / whole).cast("double"))


# --- labels ---------------------------------------------------------------------------------------------------------

def flag_label(flags: str = "tcp_flags") -> Column:
    return (F.when(has_bits(flags, SYN), "SYN").when(has_bits(flags, RST), "RST")
            .when(has_bits(flags, ACK), "ACK").otherwise("NONE"))


def protocol_class() -> Column:
    """ICMP, TCP-SYN (flags exactly SYN), TCP, UDP or OTHER."""
    return (F.when(is_icmp(), "ICMP").when(is_tcp() & (F.col("tcp_flags") == SYN), "TCP-SYN")
            .when(is_tcp(), "TCP").when(is_udp(), "UDP").otherwise("OTHER"))


def link_protocol() -> Column:
    return F.when(is_udp(), "UDP").when(is_tcp(), "TCP").when(is_wlan(), "802.11").otherwise("OTHER")


def transport_protocol() -> Column:
    return F.when(is_tcp(), "TCP").when(is_udp(), "UDP").otherwise("OTHER")


def transport_port(side: str) -> Column:
    return F.when(is_tcp() | is_udp(), F.col(side)).otherwise(0)


def ip_flag_names(flags: str | Column = "ip_flags") -> Column:
    """IP flag bits by name, low bit first, joined with ``+``."""
    names = [F.when(has_bits(flags, bit), F.lit(name)) for bit, name in ((1, "MF"), (2, "DF"), (4, "evil"))]
    return F.concat_ws("+", *names)


# --- link layer -----------------------------------------------------------------------------------------------------

def lower_mac(mac: str | Column) -> Column:
    return F.coalesce(F.lower(col(mac)), F.lit(""))


def channel_of(elements: str | Column = "elements") -> Column:
    """Channel number: first byte of the first non-empty element 3, else 0."""
    matching = F.filter(col(elements), lambda e: (e["id"] == 3) & (F.octet_length(e["info"]) > 0))
    return F.coalesce(byte_at(F.get(matching, F.lit(0))["info"], 0), F.lit(0))


def rssi_or_zero() -> Column:
    return F.coalesce(F.col("rssi"), F.lit(0))


def is_fragmented() -> Column:
    return F.coalesce(has_bits("ip_flags", 1), F.lit(False)) | F.coalesce(F.col("ip_frag") > 0, F.lit(False))


# --- payload --------------------------------------------------------------------------------------------------------

def byte_at(data: str | Column, position: int) -> Column:
    """Unsigned byte at a zero-based position."""
    return F.conv(F.hex(F.substring(col(data), position + 1, 1)), 16, 10).cast("int")


def payload_size(payload: str | Column = "payload") -> Column:
    return F.coalesce(F.octet_length(col(payload)), F.lit(0))


def payload_text(payload: str | Column = "payload") -> Column:
    """Payload as text; bytes that are not valid UTF-8 are dropped."""
    text = col(payload).cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))


def payload_latin(payload: str | Column = "payload") -> Column:
    """Payload with one character per byte, for byte patterns."""
    return F.decode(col(payload), "ISO-8859-1")


def payload_sample(payload: str | Column = "payload", length: int = 50) -> Column:
    text = payload_text(F.substring(col(payload), 1, length))
    return F.coalesce(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit(""))


def payload_md5(payload: str | Column = "payload") -> Column:
    return F.md5(col(payload))


def mavlink_header(payload: str | Column = "payload") -> Column:
    """Header of a MAVLink 2 frame (magic 0xFD, at least 11 bytes), else null."""
    valid = (F.octet_length(col(payload)) >= 11) & (byte_at(payload, 0) == 0xFD)
    message = byte_at(payload, 7) + byte_at(payload, 8) * 256 + byte_at(payload, 9) * 65536
    return F.when(valid, F.struct(byte_at(payload, 1).alias("length"), byte_at(payload, 5).alias("system_id"),
                                  byte_at(payload, 6).alias("component_id"), message.alias("message_id")))


def mqtt_type(payload: str | Column = "payload") -> Column:
    return F.shiftright(byte_at(payload, 0), 4)


# --- text -----------------------------------------------------------------------------------------------------------

def flow_text(src: str = "src_ip", dst: str = "dst_ip") -> Column:
    return F.concat(F.col(src), F.lit("->"), F.col(dst))


def endpoint_text(ip: str = "src_ip", port: str = "sport") -> Column:
    return F.concat(F.col(ip), F.lit(":"), F.col(port).cast("string"))


def connection_text() -> Column:
    return F.concat(endpoint_text("src_ip", "sport"), F.lit("->"), endpoint_text("dst_ip", "dport"))


def joined_names(named_flags: dict[str, Column]) -> Column:
    """Names of the set flags, joined with ``+`` in the given order."""
    return F.concat_ws("+", *[F.when(condition, F.lit(name)) for name, condition in named_flags.items()])


def time_text(ts: str | Column = "ts", style: str = "millis") -> Column:
    patterns = {"millis": "yyyy-MM-dd HH:mm:ss.SSS", "seconds": "yyyy-MM-dd HH:mm:ss",
                "iso": "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "clock": "HH:mm:ss"}
    if style == "iso_micros":  # whole seconds carry no fraction
        whole = F.unix_micros(col(ts)) % 1_000_000 == 0
        return F.when(whole, F.date_format(col(ts), patterns["iso"])).otherwise(
            F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
    return F.date_format(col(ts), patterns[style])


def text(*parts: str | Column) -> Column:
    """Concatenation where plain strings are literals and unknown parts become empty."""
    pieces = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return reduce(lambda a, b: F.concat(a, b), pieces)
