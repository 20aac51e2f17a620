"""Integers, variable-length codes, headers and checksums over binary columns.

Bytes are read with built-in expressions (``substring``, ``hex``, ``conv``), so
these run inside whole-stage code.  Lengths here are headers and packets; for
megabytes use the readers in :mod:`reelspark.sources`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType


def byte_at(data: Column, at: int | Column) -> Column:
    """Unsigned byte at a zero-based offset, null past the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(at < F.octet_length(data), F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("bigint"))


def big_endian(data: Column, at: int, n: int) -> Column:
    """Unsigned integer of ``n`` (up to 7) bytes, most significant first."""
    return F.when(F.octet_length(data) >= at + n, F.conv(F.hex(F.substring(data, at + 1, n)), 16, 10).cast("bigint"))


def little_endian(data: Column, at: int, n: int) -> Column:
    out = F.lit(0).cast("bigint")
    for i in range(n):
        out = out + F.shiftleft(byte_at(data, at + i), 8 * i)
    return out


def bits(data: Column, at: int | Column, n: int | Column) -> Column:
    """Unsigned integer of ``n`` (up to 40) bits from bit offset ``at``, most
    significant first; null past the end."""
    at, n = (F.lit(x) if isinstance(x, int) else x for x in (at, n))
    return F.when(at + n <= 8 * F.octet_length(data), _bits(data, at, n))


def _bits(data: Column, at: Column, n: Column) -> Column:
    """As :func:`bits`, with zeros past the end."""
    window = F.conv(F.rpad(F.hex(F.substring(data, (at / 8).cast("int") + 1, F.lit(6))), 12, "0"), 16, 10).cast("bigint")
    value = F.call_function("shiftright", window, (48 - at % 8 - n).cast("int"))
    return value.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int")) - 1)


def exp_golomb(data: Column, at: int | Column) -> Column:
    """struct(value, next) of the unsigned Exp-Golomb code at bit offset ``at``,
    of up to 15 leading zeros; ``next`` is the offset behind it.  Null where the
    code does not end."""
    at = F.lit(at) if isinstance(at, int) else at
    word = _bits(data, at, F.lit(32))
    zeros = F.when(word > 0, 32 - F.length(F.bin(word)))
    value = bits(data, at + zeros, zeros + 1) - 1
    return F.when((zeros <= 15) & value.isNotNull(), F.struct(value.alias("value"), (at + 2 * zeros + 1).cast("bigint").alias("next")))


# Sampling rates by index, channels by configuration.
ASC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
ASC_CHANNELS = (0, 1, 2, 3, 4, 5, 6, 8)


def audio_config(data: Column) -> Column:
    """struct(object_type, rate, channels) of an MPEG-4 AudioSpecificConfig;
    reserved indexes give null."""
    long_type = bits(data, 0, 5) == 31
    at = F.when(long_type, 11).otherwise(5)
    index = bits(data, at, 4)
    given = index == 15
    pick = lambda values, i: F.get(F.array(*[F.lit(v).cast("bigint") for v in values]), i.cast("int"))
    return F.struct(
        F.when(long_type, 32 + bits(data, 5, 6)).otherwise(bits(data, 0, 5)).alias("object_type"),
        F.when(given, bits(data, at + 4, 24)).otherwise(pick(ASC_RATES, index)).alias("rate"),
        pick(ASC_CHANNELS, bits(data, at + F.when(given, 28).otherwise(4), 4)).alias("channels"),
    )


def annexb_units(data: Column) -> Column:
    """Array of the NAL units of a byte stream, without start codes and trailing
    zeros; what stands before the first start code is left out."""
    parts = F.split(F.decode(data, "ISO-8859-1"), r"\x00\x00+\x01")
    trimmed = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda u: F.regexp_replace(u, r"\x00+$", ""))
    return F.transform(F.filter(trimmed, lambda u: u != ""), lambda u: F.encode(u, "ISO-8859-1"))


@F.pandas_udf(BinaryType())
def avcc_to_annexb(data: pd.Series, length_size: pd.Series) -> pd.Series:
    """A packet of length-prefixed NAL units with start codes instead; a unit that
    runs past the end is cut there.  Null stays null."""

    def convert(b, n):
        if b is None:
            return None
        out, at = bytearray(), 0
        while at + n <= len(b):
            size = int.from_bytes(b[at : at + n], "big")
            out += b"\0\0\0\1" + b[at + n : at + n + size]
            at += n + size
        return bytes(out)

    return pd.Series([convert(b, int(n)) for b, n in zip(data, length_size)])


# Profiles whose parameter sets carry the chroma format.
CHROMA_PROFILES = (44, 83, 86, 100, 110, 118, 122, 128, 134, 135, 138, 139, 244)


class _BitString:
    """Bits of one short header, read in order; ValueError past the end."""

    def __init__(self, data: bytes):
        self.s, self.at = bin(int.from_bytes(b"\1" + data, "big"))[3:], 0

    def u(self, n: int) -> int:
        self.at += n
        if self.at > len(self.s):
            raise ValueError("past the end")
        return int(self.s[self.at - n : self.at] or "0", 2)

    def ue(self) -> int:
        zeros = self.s.index("1", self.at) - self.at
        self.at += zeros
        return self.u(zeros + 1) - 1

    def se(self) -> int:
        k = self.ue()
        return k + 1 >> 1 if k & 1 else -(k >> 1)


def _picture_size(unit: bytes) -> tuple[int, int]:
    """Width and height of an H.264 sequence parameter set with its header byte."""
    if not unit or unit[0] & 31 != 7:
        raise ValueError("not a sequence parameter set")
    b = _BitString(unit[1:].replace(b"\0\0\3", b"\0\0"))
    profile = b.u(8)
    b.u(16)
    b.ue()
    chroma, separate = 1, 0
    if profile in CHROMA_PROFILES:
        chroma = b.ue()
        separate = b.u(1) if chroma == 3 else 0
        b.ue(), b.ue(), b.u(1)
        if b.u(1):
            for i in range(12 if chroma == 3 else 8):
                last = following = 8
                for _ in range((16 if i < 6 else 64) if b.u(1) else 0):
                    if following:
                        following = (last + b.se()) % 256
                    last = following or last
    b.ue()
    order = b.ue()
    if order == 0:
        b.ue()
    elif order == 1:
        b.u(1), b.se(), b.se()
        for _ in range(b.ue()):
            b.se()
    b.ue(), b.u(1)
    width, rows = 16 * (b.ue() + 1), b.ue() + 1
    frames = b.u(1)
    height = 16 * rows * (2 - frames)
    if not frames:
        b.u(1)
    b.u(1)
    if b.u(1):
        mono = chroma == 0 or separate
        x, y = 1 if mono or chroma == 3 else 2, (1 if mono or chroma != 1 else 2) * (2 - frames)
        width -= x * (b.ue() + b.ue())
        height -= y * (b.ue() + b.ue())
    if width <= 0 or height <= 0:
        raise ValueError("nothing is left")
    return width, height


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def sps_size(data: pd.Series) -> pd.DataFrame:
    """struct(width, height) of an H.264 sequence parameter set (a NAL unit without
    start code); null fields for anything else."""

    def size(b):
        try:
            return _picture_size(b) if b else (None, None)
        except ValueError:
            return None, None

    return pd.DataFrame([size(b) for b in data], columns=["width", "height"]).astype("Int32")


@F.pandas_udf(BinaryType())
def decoder_config(data: pd.Series) -> pd.Series:
    """The decoder's configuration in an ``esds`` box body (version and flags
    first); null where no such descriptor is found."""

    def find(b):
        at, end = 4, len(b or b"")
        while at < end:
            tag, size, at = b[at], 0, at + 1
            for _ in range(4):
                if at >= end:
                    return None
                size, more, at = size << 7 | b[at] & 127, b[at] & 128, at + 1
                if not more:
                    break
            if tag == 5:
                return b[at : at + size] if at + size <= end else None
            if tag == 3 and at + 3 <= end:
                flags, at = b[at + 2], at + 3
                at += 2 if flags & 128 else 0
                at += 1 + b[at] if flags & 64 and at < end else 0
                at += 2 if flags & 32 else 0
            elif tag == 4:
                at += 13
            else:
                at += size
        return None

    return pd.Series([find(b) for b in data])


def ebml_vint(data: Column) -> Column:
    """struct(id, value, size) of the variable-length integer at the start, of up to
    eight bytes: with and without its length marker.  Null where it is cut off."""
    b0 = byte_at(data, 0)
    size = F.when(b0 > 0, 9 - F.length(F.bin(b0)))
    whole = F.conv(F.hex(F.substring(data, F.lit(1), size)), 16, 10).cast("bigint")
    value = whole - F.call_function("shiftleft", F.lit(1).cast("bigint"), (7 * size).cast("int"))
    return F.when(size <= F.octet_length(data), F.struct(whole.alias("id"), value.alias("value"), size.cast("bigint").alias("size")))


def syncsafe(data: Column, at: int) -> Column:
    """Four bytes of seven bits each."""
    out = F.lit(0).cast("bigint")
    for i in range(4):
        out = out * 128 + byte_at(data, at + i).bitwiseAND(127)
    return out


def leb128(data: Column) -> Column:
    """Little-endian base 128 of up to eight bytes: struct(value, size)."""
    n = F.least(F.octet_length(data), F.lit(8))
    bs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("bigint"))
    size = F.coalesce(F.array_min(F.filter(F.transform(bs, lambda b, i: F.when(b < 128, i + 1)), lambda x: x.isNotNull())), n)
    value = F.aggregate(
        F.slice(F.transform(bs, lambda b, i: F.struct(b.alias("b"), i.alias("i"))), 1, size), F.lit(0).cast("bigint"),
        lambda a, s: a + s["b"].bitwiseAND(127) * F.pow(F.lit(128.0), s["i"]).cast("bigint"),
    )
    return F.when(n > 0, F.struct(value.alias("value"), size.alias("size")))


def ts33(data: Column, at: int = 0) -> Column:
    """33-bit time stamp from its five marker-interleaved bytes."""
    b = [byte_at(data, at + i) for i in range(5)]
    part = lambda c, mask: c.bitwiseAND(mask)
    return F.shiftleft(F.shiftright(b[0], 1).bitwiseAND(7), 30) + F.shiftleft(b[1], 22) + F.shiftleft(F.shiftright(b[2], 1), 15) + F.shiftleft(b[3], 7) + F.shiftright(part(b[4], 255), 1)


def ts33_bytes(pts: Column, prefix: int = 2) -> Column:
    """Five bytes of a 33-bit time stamp behind a four-bit prefix."""
    p = F.pmod(pts, F.lit(1 << 33))
    bs = [
        F.lit(prefix * 16) + F.shiftright(p, 30).bitwiseAND(7) * 2 + 1, F.shiftright(p, 22).bitwiseAND(255), F.shiftright(p, 15).bitwiseAND(127) * 2 + 1,
        F.shiftright(p, 7).bitwiseAND(255), p.bitwiseAND(127) * 2 + 1,
    ]
    return F.unhex(F.concat(*[F.lpad(F.hex(b.cast("bigint")), 2, "0") for b in bs]))


# fixed values: MPEG audio layer III bit rates in kb/s and sample rates in Hz
MP3_KBPS_V1 = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
MP3_KBPS_V2 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
MP3_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


def mp3_header(data: Column) -> Column:
    """struct(kbps, rate, channels, samples, size) of a layer III frame header,
    null for anything else (free format and reserved values too)."""
    b1, b2, b3 = (byte_at(data, i) for i in (1, 2, 3))
    version, layer = F.shiftright(b1, 3).bitwiseAND(3), F.shiftright(b1, 1).bitwiseAND(3)
    br, sr = F.shiftright(b2, 4), F.shiftright(b2, 2).bitwiseAND(3)
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    ok = (byte_at(data, 0) == 255) & (b1 >= 224) & (version != 1) & (layer == 1) & br.between(1, 14) & (sr < 3)
    kbps = F.when(version == 3, pick(MP3_KBPS_V1 + [0], br)).otherwise(pick(MP3_KBPS_V2 + [0], br))
    rate = F.when(version == 3, pick(MP3_RATES[3] + [0], sr)).when(version == 2, pick(MP3_RATES[2] + [0], sr)).otherwise(pick(MP3_RATES[0] + [0], sr))
    samples = F.when(version == 3, 1152).otherwise(576)
    size = F.floor(F.floor(samples / 8) * kbps * 1000 / rate).cast("bigint") + F.shiftright(b2, 1).bitwiseAND(1)
    channels = F.when(F.shiftright(b3, 6) == 3, 1).otherwise(2)
    return F.when(ok, F.struct(kbps.cast("bigint").alias("kbps"), rate.cast("bigint").alias("rate"), channels.cast("bigint").alias("channels"), samples.cast("bigint").alias("samples"), size.alias("size")))


def crc(data: Column, bits: int, poly: int, start: int = 0) -> Column:
    """Cyclic redundancy check, most significant bit first, no reflection and no
    final XOR; ``bits`` up to 32."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    step = lambda c: F.when(c.bitwiseAND(top) != 0, (F.shiftleft(c, 1)).bitwiseXOR(F.lit(poly))).otherwise(F.shiftleft(c, 1)).bitwiseAND(mask)
    bs = F.transform(F.sequence(F.lit(0), F.octet_length(data) - 1), lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("bigint"))
    # one fold step a bit keeps the expression small
    each = F.flatten(F.transform(bs, lambda b: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(k == 0, b).otherwise(F.lit(-1).cast("bigint")))))
    enter = lambda c, b: F.when(b >= 0, c.bitwiseXOR(F.shiftleft(b, bits - 8))).otherwise(c)
    out = F.aggregate(each, F.lit(start).cast("bigint"), lambda c, b: step(enter(c, b)))
    return F.when(F.octet_length(data) == 0, F.lit(start).cast("bigint")).otherwise(out)


def crc32_ogg(data: Column) -> Column:
    return crc(data, 32, 0x04C11DB7)


def crc32_mpeg(data: Column) -> Column:
    return crc(data, 32, 0x04C11DB7, 0xFFFFFFFF)


def crc8_flac(data: Column) -> Column:
    return crc(data, 8, 0x07)


def crc16_flac(data: Column) -> Column:
    return crc(data, 16, 0x8005)


def adler32(data: Column) -> Column:
    bs = F.transform(F.sequence(F.lit(0), F.octet_length(data) - 1), lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("bigint"))
    start = F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    out = F.aggregate(bs, start, lambda s, x: F.struct(((s["a"] + x) % 65521).alias("a"), ((s["b"] + s["a"] + x) % 65521).alias("b")), lambda s: s["b"] * 65536 + s["a"])
    return F.when(F.octet_length(data) == 0, F.lit(1).cast("bigint")).otherwise(out)


def png_16_to_8(v: Column) -> Column:
    return F.least(F.shiftright(v + 128, 8), F.lit(255))
