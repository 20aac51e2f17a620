"""Container parsers: bytes to streams and packets.

Each parser takes the whole file and returns ``(streams, packets)``: stream
dicts and ``(idx, pts, dts, duration, keyframe, data)`` tuples.  All counts and
sizes come from untrusted bytes, so every loop is bounded by the data present;
a malformed file raises :class:`FormatError`, never anything else that matters.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

from ..functions.binary import MP3_KBPS_V1, MP3_KBPS_V2, MP3_RATES


class FormatError(ValueError):
    """The bytes are not a readable file of this format."""


def _need(ok, why: str) -> None:
    if not ok:
        raise FormatError(why)


def _stream(idx, media_type, codec, tb=(1, 1000), **more):
    return {"idx": idx, "media_type": media_type, "codec": codec, "tb_num": tb[0], "tb_den": tb[1], **more}


def wav(b: bytes):
    _need(b[:4] == b"RIFF" and b[8:12] == b"WAVE", "not a WAVE file")
    at, fmt, data = 12, None, None
    while at + 8 <= len(b):
        name, size = b[at : at + 4], struct.unpack_from("<I", b, at + 4)[0]
        body = b[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            fmt = struct.unpack_from("<HHIIHH", body)
        elif name == b"data":
            data = body
        at += 8 + size + (size & 1)
    _need(fmt and data is not None, "no format or no data")
    kind = {(1, 16): "s16", (3, 32): "flt"}.get((fmt[0], fmt[5]))
    _need(kind and fmt[1] and fmt[2], f"unsupported samples {fmt[0]}/{fmt[5]}")
    n = len(data) // (fmt[1] * fmt[5] // 8)
    s = _stream(0, "audio", "pcm", (1, fmt[2]), sample_rate=fmt[2], channels=fmt[1], sample_fmt=kind, duration=n)
    return [s], [(0, 0, 0, n, True, data)]


# fixed values: colour space tags of raw video headers
Y4M_FORMATS = {
    "420": "yuv420p", "420jpeg": "yuv420p", "420mpeg2": "yuv420p", "420paldv": "yuv420p", "422": "yuv422p", "444": "yuv444p",
    "420p10": "yuv420p10le", "422p10": "yuv422p10le", "444p10": "yuv444p10le", "420p12": "yuv420p12le", "422p12": "yuv422p12le", "444p12": "yuv444p12le",
}


def frame_size(pixfmt: str, w: int, h: int) -> int:
    """Bytes of a tightly packed frame."""
    wide = 2 if pixfmt.endswith("le") else 1
    if pixfmt in ("rgb24", "rgba"):
        return w * h * (3 if pixfmt == "rgb24" else 4)
    cw = w if "444" in pixfmt else -(-w // 2)
    ch = -(-h // 2) if "420" in pixfmt else h
    return wide * (w * h + 2 * cw * ch)


def y4m(b: bytes):
    _need(b.startswith(b"YUV4MPEG2"), "not raw video")
    end = b.find(b"\n", 0, 4096)
    _need(end > 0, "no header line")
    w = h = 0
    rate, pixfmt, color = (25, 1), "yuv420p", None
    for tag in b[9:end].decode("latin-1").split():
        key, val = tag[0], tag[1:]
        if key in "WH" and val.isdigit():
            w, h = (int(val), h) if key == "W" else (w, int(val))
        elif key == "F" and ":" in val:
            n, _, d = val.partition(":")
            _need(n.isdigit() and d.isdigit() and int(n) and int(d), "bad rate")
            rate = (int(n), int(d))
        elif key == "C":
            _need(val in Y4M_FORMATS, f"unsupported colour space {val}")
            pixfmt = Y4M_FORMATS[val]
        elif tag.startswith("XCOLORRANGE="):
            color = {"FULL": "full", "LIMITED": "limited"}.get(tag[12:])
    _need(w and h, "no size")
    size, at, out = frame_size(pixfmt, w, h), end + 1, []
    while b.startswith(b"FRAME", at):
        line = b.find(b"\n", at)
        if line < 0 or line + 1 + size > len(b):
            break
        out.append((0, len(out), len(out), 1, True, b[line + 1 : line + 1 + size]))
        at = line + 1 + size
    s = _stream(0, "video", "rawvideo", (rate[1], rate[0]), width=w, height=h, pixfmt=pixfmt, color_range=color, nb_frames=len(out))
    return [s], out


def ivf(b: bytes):
    _need(b[:4] == b"DKIF" and len(b) >= 32, "not an IVF file")
    head, fourcc = struct.unpack_from("<H", b, 6)[0], b[8:12]
    w, h, den, num = struct.unpack_from("<HHII", b, 12)
    codec = {b"VP90": "vp9", b"AV02": "av2"}.get(fourcc)
    _need(codec, f"unsupported codec {fourcc!r}")
    at, out = max(head, 32), []
    while at + 12 <= len(b):
        size, pts = struct.unpack_from("<IQ", b, at)
        if at + 12 + size > len(b):
            break
        out.append((0, pts, pts, 1, not out, b[at + 12 : at + 12 + size]))
        at += 12 + size
    return [_stream(0, "video", codec, (max(num, 1), max(den, 1)), width=w, height=h, nb_frames=len(out))], out


def ogg_packets(b: bytes) -> list[bytes]:
    """Packets across pages: a lacing value under 255 ends one."""
    out, part, at = [], bytearray(), 0
    while at + 27 <= len(b) and b[at : at + 4] == b"OggS":
        n = b[at + 26]
        data = at + 27 + n
        if data > len(b):
            break
        for lace in b[at + 27 : data]:
            part += b[data : data + lace]
            data += lace
            if lace < 255:
                out.append(bytes(part))
                part = bytearray()
        at = data
    return out


def ogg(b: bytes):
    ps = ogg_packets(b)
    _need(ps, "no packets")
    if ps[0].startswith(b"OpusHead") and len(ps[0]) >= 19:
        s = _stream(0, "audio", "opus", (1, 48000), sample_rate=48000, channels=ps[0][9], extradata=ps[0])
        body = ps[2:]
    elif ps[0].startswith(b"\x01vorbis") and len(ps[0]) >= 16:
        ch, rate = ps[0][11], struct.unpack_from("<I", ps[0], 12)[0]
        s = _stream(0, "audio", "vorbis", (1, max(rate, 1)), sample_rate=rate, channels=ch, extradata=b"".join(struct.pack(">I", len(p)) + p for p in ps[:3]))
        body = ps[3:]
    else:
        raise FormatError("neither Opus nor Vorbis")
    return [s], [(0, None, None, 0, True, p) for p in body]


def flac(b: bytes):
    _need(b[:4] == b"fLaC" and len(b) >= 42, "not a FLAC file")
    bits = int.from_bytes(b[18:26], "big")
    rate, ch, total = bits >> 44, (bits >> 41 & 7) + 1, bits & (1 << 36) - 1
    return [_stream(0, "audio", "flac", (1, max(rate, 1)), sample_rate=rate, channels=ch, duration=total)], [(0, 0, 0, total, True, b)]


def _mp3_frame(b: bytes, at: int):
    if at + 4 > len(b) or b[at] != 255 or b[at + 1] < 224:
        return None
    version, layer, br, sr = b[at + 1] >> 3 & 3, b[at + 1] >> 1 & 3, b[at + 2] >> 4, b[at + 2] >> 2 & 3
    if version == 1 or layer != 1 or br in (0, 15) or sr == 3:
        return None
    kbps, rate = (MP3_KBPS_V1 if version == 3 else MP3_KBPS_V2)[br], MP3_RATES[version][sr]
    samples = 1152 if version == 3 else 576
    return samples // 8 * kbps * 1000 // rate + (b[at + 2] >> 1 & 1), rate, 1 if b[at + 3] >> 6 == 3 else 2, samples


def mp3(b: bytes):
    at = 0
    if b[:3] == b"ID3" and len(b) >= 10:
        at = 10 + (b[6] << 21 | b[7] << 14 | b[8] << 7 | b[9])
    out, first, pts = [], None, 0
    while at < len(b):
        f = _mp3_frame(b, at)
        if not f:
            at += 1
            continue
        size, rate, ch, samples = f
        if at + size > len(b):
            break
        data = b[at : at + size]
        if first is None:
            first = (rate, ch)
            if b"Xing" in data[:64] or b"Info" in data[:64]:  # header frame without audio
                at += size
                continue
        out.append((0, pts, pts, samples, True, data))
        pts += samples
        at += size
    _need(first, "no frames")
    return [_stream(0, "audio", "mp3", (1, first[0]), sample_rate=first[0], channels=first[1], duration=pts)], out


def adts(b: bytes):
    rates = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]
    at, out, head = 0, [], None
    while at + 7 <= len(b):
        if b[at] != 255 or b[at + 1] & 0xF6 != 0xF0:
            at += 1
            continue
        sf, ch = b[at + 2] >> 2 & 15, (b[at + 2] & 1) << 2 | b[at + 3] >> 6
        size = (b[at + 3] & 3) << 11 | b[at + 4] << 3 | b[at + 5] >> 5
        skip = 7 if b[at + 1] & 1 else 9
        if sf >= len(rates) or size < skip:
            at += 1
            continue
        if at + size > len(b):
            break
        head = head or (rates[sf], ch)
        out.append((0, 1024 * len(out), 1024 * len(out), 1024, True, b[at + skip : at + size]))
        at += size
    _need(head, "no frames")
    return [_stream(0, "audio", "aac", (1, head[0]), sample_rate=head[0], channels=head[1])], out


def boxes(b: bytes, start: int = 0, end: int | None = None):
    """(name, body start, body end) of the boxes of a range."""
    end = len(b) if end is None else end
    at = start
    while at + 8 <= end:
        size, name = struct.unpack_from(">I4s", b, at)
        body = at + 8
        if size == 1 and at + 16 <= end:
            size, body = struct.unpack_from(">Q", b, at + 8)[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            break
        yield name, body, at + size
        at += size


def _find(b, rng, *path):
    for name in path:
        rng = next(((s, e) for n, s, e in boxes(b, *rng) if n == name), None) if rng else None
    return rng


def _table(b, rng, fmt, head=8):
    if not rng:
        return []
    s, e = rng
    step = struct.calcsize(fmt)
    count = struct.unpack_from(">I", b, s + head - 4)[0] if e - s >= head else 0
    return [struct.unpack_from(fmt, b, s + head + step * i) for i in range(min(count, (e - s - head) // step))]


# fixed values: sample entry names
MP4_CODECS = {b"avc1": "h264", b"avc3": "h264", b"vp09": "vp9", b"Opus": "opus", b"mp4a": "aac"}


def mp4(b: bytes):
    moov = _find(b, (0, len(b)), b"moov")
    _need(moov, "no moov")
    streams, packets = [], []
    for name, s, e in boxes(b, *moov):
        if name != b"trak":
            continue
        mdia = _find(b, (s, e), b"mdia")
        mdhd, hdlr, stbl = _find(b, mdia, b"mdhd"), _find(b, mdia, b"hdlr"), _find(b, mdia, b"minf", b"stbl")
        stsd = _find(b, stbl, b"stsd")
        if not (mdhd and hdlr and stsd and stsd[1] - stsd[0] >= 16):
            continue
        scale = struct.unpack_from(">I", b, mdhd[0] + (20 if b[mdhd[0]] == 1 else 12))[0] if mdhd[1] - mdhd[0] >= 24 else 1000
        kind = {b"vide": "video", b"soun": "audio", b"text": "subtitle"}.get(b[hdlr[0] + 8 : hdlr[0] + 12], "data")
        entry = stsd[0] + 16
        more = {}
        if kind == "video" and entry + 28 <= stsd[1]:
            more = dict(zip(("width", "height"), struct.unpack_from(">HH", b, entry + 24)))
        if kind == "audio" and entry + 28 <= stsd[1]:
            more = {"channels": struct.unpack_from(">H", b, entry + 16)[0], "sample_rate": struct.unpack_from(">I", b, entry + 24)[0] >> 16}
        idx = len(streams)
        streams.append(_stream(idx, kind, MP4_CODECS.get(b[stsd[0] + 12 : stsd[0] + 16], "none"), (1, max(scale, 1)), **more))
        packets += _mp4_track(b, stbl, idx)
    packets.sort(key=lambda p: p[0])
    return streams, [p[1:] for p in packets]


def _mp4_track(b, stbl, idx):
    box = lambda n: _find(b, stbl, n)
    stsz = box(b"stsz")
    if not stsz or stsz[1] - stsz[0] < 12:
        return []
    same, count = struct.unpack_from(">II", b, stsz[0] + 4)
    count = min(count, len(b)) if same else min(count, (stsz[1] - stsz[0] - 12) // 4)
    sizes = [same] * count if same else [x[0] for x in _table(b, stsz, ">I", 12)]
    offsets = [x[0] for x in _table(b, box(b"stco"), ">I")] or [x[0] for x in _table(b, box(b"co64"), ">Q")]
    runs = _table(b, box(b"stsc"), ">III")
    sync = {x[0] for x in _table(b, box(b"stss"), ">I")} if box(b"stss") else None
    times, pts = [], 0
    for n, delta in _table(b, box(b"stts"), ">II"):
        for _ in range(min(n, len(sizes) - len(times))):
            times.append((pts, delta))
            pts += delta
    out, i, r = [], 0, -1
    for chunk, at in enumerate(offsets, 1):
        while r + 1 < len(runs) and runs[r + 1][0] <= chunk:
            r += 1
        for _ in range(min(runs[r][1], len(sizes) - i) if r >= 0 else 0):
            t = times[i] if i < len(times) else (0, 0)
            if at + sizes[i] <= len(b):
                out.append((at, idx, t[0], t[0], t[1], sync is None or i + 1 in sync, b[at : at + sizes[i]]))
            at += sizes[i]
            i += 1
    return out


def _vint(b, at, keep):
    if at >= len(b) or not b[at]:
        return None, at + 1
    n = 9 - b[at].bit_length()
    v = int.from_bytes(b[at : at + n], "big")
    return (v if keep else v & (1 << 7 * n) - 1), at + n


def ebml(b, start, end):
    """(id, body start, body end); an unknown size runs to the end."""
    at = start
    while at < end:
        eid, at1 = _vint(b, at, True)
        if eid is None:
            return
        size, body = _vint(b, at1, False)
        if size is None:
            return
        n = body - at1
        stop = end if size == (1 << 7 * n) - 1 else min(body + size, end)
        yield eid, body, stop
        at = stop


# fixed values: codec identifiers
MKV_CODECS = {"V_VP9": "vp9", "V_MPEG4/ISO/AVC": "h264", "V_AV2": "av2", "A_OPUS": "opus", "A_VORBIS": "vorbis", "A_AAC": "aac", "A_MPEG/L3": "mp3", "A_FLAC": "flac", "S_TEXT/UTF8": "subrip", "S_TEXT/WEBVTT": "webvtt"}


def mkv(b: bytes):
    _need(b[:4] == b"\x1aE\xdf\xa3", "not EBML")
    uint = lambda s, e: int.from_bytes(b[s:e], "big")
    streams, number, packets, scale = [], {}, [], 1_000_000

    def block(s, e, base, key):
        track, at = _vint(b, s, False)
        if track not in number or at + 3 > e:
            return
        rel, flags = struct.unpack_from(">hB", b, at)
        if flags & 6:  # laced blocks are not split
            return
        packets.append((number[track], base + rel, base + rel, 0, flags & 128 != 0 if key is None else key, b[at + 3 : e]))

    for eid, s, e in ebml(b, 0, len(b)):
        if eid != 0x18538067:
            continue
        for sid, s1, e1 in ebml(b, s, e):
            if sid == 0x1549A966:
                scale = next((uint(x, y) for i, x, y in ebml(b, s1, e1) if i == 0x2AD7B1), scale)
            elif sid == 0x1654AE6B:
                for tid, s2, e2 in ebml(b, s1, e1):
                    if tid != 0xAE:
                        continue
                    t = {i: (x, y) for i, x, y in ebml(b, s2, e2)}
                    text = lambda i: b[slice(*t[i])].rstrip(b"\0").decode("latin-1") if i in t else ""  # noqa: E731, B023
                    kind = {1: "video", 2: "audio", 17: "subtitle"}.get(uint(*t[0x83]) if 0x83 in t else 0, "data")
                    more = {}
                    if 0xE0 in t:
                        v = {i: uint(x, y) for i, x, y in ebml(b, *t[0xE0])}
                        more = {"width": v.get(0xB0, 0), "height": v.get(0xBA, 0)}
                    if 0xE1 in t:
                        a = {i: (x, y) for i, x, y in ebml(b, *t[0xE1])}
                        raw = b[slice(*a[0xB5])] if 0xB5 in a else b""
                        rate = struct.unpack(">f" if len(raw) == 4 else ">d", raw)[0] if len(raw) in (4, 8) else 8000
                        more = {"sample_rate": int(rate), "channels": uint(*a[0x9F]) if 0x9F in a else 1}
                    if 0x63A2 in t:
                        more["extradata"] = b[slice(*t[0x63A2])]
                    number.setdefault(uint(*t[0xD7]) if 0xD7 in t else 0, len(streams))
                    streams.append(_stream(len(streams), kind, MKV_CODECS.get(text(0x86), "none"), (scale, 1_000_000_000), **more))
            elif sid == 0x1F43B675:
                base = 0
                for cid, s2, e2 in ebml(b, s1, e1):
                    if cid == 0xE7:
                        base = uint(s2, e2)
                    elif cid == 0xA3:
                        block(s2, e2, base, None)
                    elif cid == 0xA0:
                        g = {i: (x, y) for i, x, y in ebml(b, s2, e2)}
                        if 0xA1 in g:
                            block(*g[0xA1], base, 0xFB not in g)
    _need(streams, "no tracks")
    return streams, packets


# fixed values: AVI stream identifiers
AVI_CODECS = {b"H264": "h264", b"h264": "h264", b"avc1": "h264", b"VP90": "vp9", b"MJPG": "mjpeg"}


def avi(b: bytes):
    _need(b[:4] == b"RIFF" and b[8:12] == b"AVI ", "not an AVI file")
    streams, packets = [], []

    def walk(at, end, depth=0):
        head = None
        while at + 8 <= end and depth < 8:
            name, size = b[at : at + 4], struct.unpack_from("<I", b, at + 4)[0]
            body, stop = at + 8, min(at + 8 + size, end)
            if name == b"LIST" and body + 4 <= stop:
                walk(body + 4, stop, depth + 1)
            elif name == b"strh" and stop - body >= 32:
                head = (b[body : body + 4], b[body + 4 : body + 8], *struct.unpack_from("<II", b, body + 20))
            elif name == b"strf" and head:
                kind, tag, scale, rate = head
                tb = (max(scale, 1), max(rate, 1))
                if kind == b"vids" and stop - body >= 20:
                    w, h = struct.unpack_from("<ii", b, body + 4)
                    streams.append(_stream(len(streams), "video", AVI_CODECS.get(b[body + 16 : body + 20], AVI_CODECS.get(tag, "none")), tb, width=w, height=abs(h)))
                elif kind == b"auds" and stop - body >= 16:
                    fmt, ch, hz = struct.unpack_from("<HHI", b, body)
                    streams.append(_stream(len(streams), "audio", {1: "pcm", 3: "pcm", 0x55: "mp3", 0xFF: "aac"}.get(fmt, "none"), tb, sample_rate=hz, channels=ch))
                else:
                    streams.append(_stream(len(streams), "data", "none", tb))
            elif name[:2].isdigit() and name[2:] in (b"dc", b"db", b"wb"):
                i = int(name[:2])
                if i < len(streams):
                    packets.append((i, None, None, 0, True, b[body:stop]))
            at = body + size + (size & 1)

    walk(12, len(b))
    _need(streams, "no streams")
    return streams, packets


def _time33(b, at):
    return (b[at] >> 1 & 7) << 30 | b[at + 1] << 22 | (b[at + 2] >> 1) << 15 | b[at + 3] << 7 | b[at + 4] >> 1


# fixed values: stream types of a programme map
TS_CODECS = {0x1B: ("video", "h264"), 0x0F: ("audio", "aac"), 0x03: ("audio", "mp3"), 0x04: ("audio", "mp3")}


def ts(b: bytes):
    streams, index, pmts, part, packets = [], {}, set(), {}, []

    def emit(pid):
        key, data = part.pop(pid)
        if len(data) < 9 or data[:3] != b"\0\0\1":
            return
        flags, head = data[7] >> 6, data[8]
        pts = _time33(data, 9) if flags & 2 and len(data) >= 14 else None
        dts = _time33(data, 14) if flags == 3 and len(data) >= 19 else pts
        size = struct.unpack_from(">H", data, 4)[0]
        packets.append((index[pid], pts, dts, 0, key, bytes(data[9 + head : 6 + size if size else None])))

    at = 0
    while at + 188 <= len(b):
        if b[at] != 0x47:
            at = b.find(b"\x47", at + 1)
            if at < 0:
                break
            continue
        p = b[at : at + 188]
        at += 188
        pid, pusi, has = (p[1] & 31) << 8 | p[2], p[1] & 64 != 0, p[3] >> 4 & 3
        off, rai = 4, False
        if has & 2:
            rai = p[4] > 0 and p[5] & 64 != 0
            off = 5 + p[4]
        if not has & 1 or off >= 188:
            continue
        body = p[off:]
        if (pid == 0 or pid in pmts) and pusi and body[0] + 9 < len(body):
            sec = body[1 + body[0] :]
            end = min(3 + ((sec[1] & 15) << 8 | sec[2]) - 4, len(sec))
            if pid == 0:
                for i in range(8, end - 3, 4):
                    if sec[i] << 8 | sec[i + 1]:
                        pmts.add((sec[i + 2] & 31) << 8 | sec[i + 3])
            elif len(sec) > 12:
                i = 12 + ((sec[10] & 15) << 8 | sec[11])
                while i + 5 <= end:
                    es = (sec[i + 1] & 31) << 8 | sec[i + 2]
                    if sec[i] in TS_CODECS and es not in index:
                        index[es] = len(streams)
                        streams.append(_stream(len(streams), *TS_CODECS[sec[i]], (1, 90000)))
                    i += 5 + ((sec[i + 3] & 15) << 8 | sec[i + 4])
        elif pid in index:
            if pusi:
                if pid in part:
                    emit(pid)
                part[pid] = (rai, bytearray())
            if pid in part:
                data = part[pid][1]
                data += body
                if len(data) >= 6 and (n := struct.unpack_from(">H", data, 4)[0]) and len(data) >= 6 + n:
                    emit(pid)
    for pid in list(part):
        emit(pid)
    _need(streams, "no programme")
    return streams, packets


def flv(b: bytes):
    _need(b[:3] == b"FLV" and len(b) >= 13, "not an FLV file")
    at, streams, index, packets = struct.unpack_from(">I", b, 5)[0] + 4, [], {}, []

    def stream(kind, codec, extra):
        if kind not in index:
            index[kind] = len(streams)
            streams.append(_stream(len(streams), kind, codec, (1, 1000), extradata=extra))

    while at + 11 <= len(b):
        tag, size = b[at], int.from_bytes(b[at + 1 : at + 4], "big")
        t = int.from_bytes(b[at + 4 : at + 7], "big") | b[at + 7] << 24
        d = b[at + 11 : at + 11 + size]
        at += 15 + size
        if tag == 9 and len(d) >= 5 and d[0] & 15 == 7:
            cts = int.from_bytes(d[2:5], "big", signed=True)  # signed on the wire
            if d[1] == 0:
                stream("video", "h264", d[5:])
            elif d[1] == 1 and "video" in index:
                packets.append((index["video"], t + cts, t, 0, d[0] >> 4 == 1, d[5:]))
        elif tag == 8 and len(d) >= 2 and d[0] >> 4 == 10:
            if d[1] == 0:
                stream("audio", "aac", d[2:])
            elif "audio" in index:
                packets.append((index["audio"], t, t, 0, True, d[2:]))
    _need(streams, "no streams")
    return streams, packets


def _image(codec, w, h, b, **more):
    return [_stream(0, "video", codec, (1, 25), width=w, height=h, nb_frames=1, **more)], [(0, 0, 0, 1, True, b)]


def png(b: bytes):
    _need(b[:8] == b"\x89PNG\r\n\x1a\n" and b[12:16] == b"IHDR" and len(b) >= 24, "not a PNG image")
    return _image("png", *struct.unpack_from(">II", b, 16), b)


def gif(b: bytes):
    _need(b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10, "not a GIF image")
    return _image("gif", *struct.unpack_from("<HH", b, 6), b)


def jpeg(b: bytes):
    _need(b[:2] == b"\xff\xd8", "not a JPEG image")
    at = 2
    while at + 9 <= len(b):
        if b[at] != 0xFF:
            at += 1
            continue
        m = b[at + 1]
        if m == 0xFF:
            at += 1
        elif m in (0x01, *range(0xD0, 0xD9)):
            at += 2
        elif 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", b, at + 5)
            return _image("mjpeg", w, h, b)
        else:
            at += 2 + struct.unpack_from(">H", b, at + 2)[0]
    raise FormatError("no frame header")


def webp(b: bytes):
    _need(b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30, "not a WebP image")
    name = b[12:16]
    if name == b"VP8 ":
        w, h = (x & 0x3FFF for x in struct.unpack_from("<HH", b, 26))
        return _image("webp", w, h, b, color_range="limited")
    if name == b"VP8L":
        v = struct.unpack_from("<I", b, 21)[0]
        return _image("webp", (v & 0x3FFF) + 1, (v >> 14 & 0x3FFF) + 1, b)
    _need(name == b"VP8X", "unknown WebP chunk")
    w, h = (int.from_bytes(b[i : i + 3], "little") + 1 for i in (24, 27))
    s, p = _image("webp", w, h, b)
    if b[20] & 2:
        s[0].update(tb_num=1, tb_den=1000)
    return s, p


def avif(b: bytes):
    ftyp = next(boxes(b), None)
    _need(ftyp and ftyp[0] == b"ftyp", "no ftyp")
    meta = _find(b, (0, len(b)), b"meta")
    _need(meta, "no meta")
    inner = (meta[0] + 4, meta[1])
    ispe = _find(b, inner, b"iprp", b"ipco", b"ispe")
    w, h = struct.unpack_from(">II", b, ispe[0] + 4) if ispe and ispe[1] - ispe[0] >= 12 else (0, 0)
    iloc = _find(b, inner, b"iloc")
    _need(iloc and iloc[1] - iloc[0] >= 8, "no item location")
    s = iloc[0]
    ver, so, ss, bo = b[s], b[s + 4] >> 4, b[s + 4] & 15, b[s + 5] >> 4
    at = s + 8 + (2 if ver < 2 else 4) + (2 if ver else 0) + 2
    base = int.from_bytes(b[at : at + bo], "big")
    at += bo + 2 + ((b[s + 5] & 15) if ver else 0)
    off, n = int.from_bytes(b[at : at + so], "big"), int.from_bytes(b[at + so : at + so + ss], "big")
    data = b[base + off : base + off + n]
    _need(n and len(data) == n, "item outside the file")
    return _image("avif", w, h, data)


def _cues(codec):
    def parse(b: bytes):
        return [_stream(0, "subtitle", codec, (1, 1000))], [(0, s, s, e - s, True, t.encode()) for s, e, t in text_cues(b.decode("utf-8", "replace"))]

    return parse


def text_cues(text: str):
    """(start_ms, end_ms, text) of SubRip or WebVTT text."""
    stamp = re.compile(r"\s*(?:(?:.*:)?\s*(\d+)\s*:)?\s*(\d+)\s*:\s*(\d+)\s*[,.]\s*(\d+)\s*$")

    def ms(s):
        m = stamp.match(s)
        return ((int(m[1] or 0) * 60 + int(m[2])) * 60 + int(m[3])) * 1000 + int(m[4]) if m else None

    out = []
    for part in text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿").split("\n\n"):
        lines = part.strip("\n").split("\n")
        for i, line in enumerate(lines):
            a, arrow, z = line.partition("-->")
            if arrow and z.split() and (s := ms(a)) is not None and (e := ms(z.split()[0])) is not None:
                out.append((s, e, "\n".join(lines[i + 1 :])))
                break
    return out


PARSERS: dict[str, Callable] = {
    "wav": wav, "yuv4mpegpipe": y4m, "ivf": ivf, "ogg": ogg, "flac": flac, "mp3": mp3, "aac": adts, "mp4": mp4, "matroska": mkv, "avi": avi, "mpegts": ts,
    "flv": flv, "png": png, "gif": gif, "jpeg": jpeg, "webp": webp, "avif": avif, "srt": _cues("subrip"), "webvtt": _cues("webvtt"),
}
