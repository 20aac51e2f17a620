"""Container writers: ordered packets to bytes.

``write_files`` gathers one output's packets into one task, which a single file
needs anyway; rows are sorted within their partition and streamed, so only one
output is in memory at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import deal
from .demux import Y4M_FORMATS, FormatError

#: Rows of an Arrow batch that are Python objects at once.
ROWS = 256


def wav(streams, packets):
    s = streams[0]
    if len(streams) != 1 or s["codec"] != "pcm":
        raise FormatError("one PCM stream is needed")
    data = b"".join(p[5] for p in packets)
    tag, bits = (3, 32) if s["sample_fmt"] == "flt" else (1, 16)
    ch, rate = s["channels"], s["sample_rate"]
    fmt = struct.pack("<HHIIHH", tag, ch, rate, rate * ch * bits // 8, ch * bits // 8, bits)
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 36 + len(data) + len(pad)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data + pad


def y4m(streams, packets):
    s = streams[0]
    tag = next(k for k, v in Y4M_FORMATS.items() if v == (s.get("pixfmt") or "yuv420p"))
    head = f"YUV4MPEG2 W{s['width']} H{s['height']} F{s['tb_den']}:{s['tb_num']} Ip A1:1 C{tag}"
    if s.get("color_range"):
        head += f" XCOLORRANGE={s['color_range'].upper()}"
    return head.encode() + b"\n" + b"".join(b"FRAME\n" + p[5] for p in packets)


def ivf(streams, packets):
    s = streams[0]
    fourcc = {"vp9": b"VP90", "av2": b"AV02"}.get(s["codec"])
    if not fourcc:
        raise FormatError(f"{s['codec']} has no IVF code")
    ps = list(packets)
    head = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, fourcc, s["width"], s["height"], s["tb_den"], s["tb_num"], len(ps), 0)
    return head + b"".join(struct.pack("<IQ", len(p[5]), i) + p[5] for i, p in enumerate(ps))  # pts is the frame number


def _ogg_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_OGG_CRC = _ogg_table()


def ogg_crc(data: bytes) -> int:
    c = 0
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _OGG_CRC[c >> 24 ^ x]
    return c


def ogg_page(packet: bytes, serial: int, seq: int, granule: int, flags: int) -> bytes:
    laces = [255] * (len(packet) // 255) + [len(packet) % 255]
    if len(laces) > 255:
        raise FormatError("packet too large for one page")
    head = b"OggS" + struct.pack("<BBqIII", 0, flags, granule, serial, seq, 0) + bytes([len(laces)]) + bytes(laces)
    page = bytearray(head + packet)
    struct.pack_into("<I", page, 22, ogg_crc(page))
    return bytes(page)


def ogg(streams, packets):
    s = streams[0]
    if s["codec"] != "opus":
        raise FormatError("only Opus is written")
    head = s.get("extradata") or b"OpusHead" + struct.pack("<BBHIhB", 1, s["channels"], 312, 48000, 0, 0)
    out = [ogg_page(head, 1, 0, 0, 2), ogg_page(b"OpusTags" + struct.pack("<I", 9) + b"reelspark" + struct.pack("<I", 0), 1, 1, 0, 0)]
    ps, at = list(packets), 0
    for i, p in enumerate(ps):
        at += p[3] or 960
        out.append(ogg_page(p[5], 1, i + 2, at, 4 if i == len(ps) - 1 else 0))
    return b"".join(out)


def concat(streams, packets):
    return b"".join(p[5] for p in packets)


def first(streams, packets):
    return next(iter(packets))[5]


def flv(streams, packets):
    kinds = {s["idx"]: s["media_type"] for s in streams}
    flags = (4 if "audio" in kinds.values() else 0) | (1 if "video" in kinds.values() else 0)

    def tag(kind, t, body):
        return bytes([kind]) + len(body).to_bytes(3, "big") + (t & 0xFFFFFF).to_bytes(3, "big") + bytes([t >> 24 & 255]) + b"\0\0\0" + body + struct.pack(">I", 11 + len(body))

    out = [b"FLV\x01" + bytes([flags]) + struct.pack(">II", 9, 0)]
    for s in streams:
        extra = s.get("extradata") or b""
        out.append(tag(9, 0, b"\x17\0\0\0\0" + extra) if s["media_type"] == "video" else tag(8, 0, b"\xaf\0" + extra))
    num = {s["idx"]: (s["tb_num"], s["tb_den"]) for s in streams}
    for idx, pts, dts, _, key, data in packets:
        n, d = num[idx]
        ms = lambda v: (v or 0) * 1000 * n // d  # noqa: E731, B023
        t = ms(dts if dts is not None else pts)
        if kinds[idx] == "video":
            out.append(tag(9, t, bytes([0x17 if key else 0x27, 1]) + (ms(pts) - t & 0xFFFFFF).to_bytes(3, "big") + data))
        else:
            out.append(tag(8, t, b"\xaf\x01" + data))
    return b"".join(out)


def avi(streams, packets):
    chunk = lambda n, d: n + struct.pack("<I", len(d)) + d + b"\0" * (len(d) & 1)
    lst = lambda n, d: chunk(b"LIST", n + d)
    code = {"h264": b"H264", "vp9": b"VP90", "mjpeg": b"MJPG"}
    ps = list(packets)
    strl = b""
    for s in streams:
        n = sum(p[0] == s["idx"] for p in ps)
        video = s["media_type"] == "video"
        fcc = code.get(s["codec"], b"\0\0\0\0") if video else b"\0\0\0\0"
        strh = (b"vids" if video else b"auds") + fcc + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, s["tb_num"], s["tb_den"], 0, n, 0, -1, 0, 0, 0, 0, 0)
        strf = struct.pack("<IiiHH4sIiiII", 40, s["width"], s["height"], 1, 24, fcc, 0, 0, 0, 0, 0) if video else struct.pack("<HHIIHH", {"mp3": 0x55, "aac": 0xFF}.get(s["codec"], 1), s["channels"], s["sample_rate"], 0, 1, 16)
        strl += lst(b"strl", chunk(b"strh", strh) + chunk(b"strf", strf))
    v = next((s for s in streams if s["media_type"] == "video"), None)
    avih = struct.pack("<14I", 0, 0, 0, 16, len(ps), 0, len(streams), 0, v["width"] if v else 0, v["height"] if v else 0, 0, 0, 0, 0)
    kind = {s["idx"]: b"%02d%s" % (s["idx"], b"dc" if s["media_type"] == "video" else b"wb") for s in streams}
    movi, idx1, at = b"", b"", 4
    for p in ps:
        c = chunk(kind[p[0]], p[5])
        idx1 += kind[p[0]] + struct.pack("<III", 16 if p[4] else 0, at, len(p[5]))
        movi += c
        at += len(c)
    body = b"AVI " + lst(b"hdrl", chunk(b"avih", avih) + strl) + lst(b"movi", movi) + chunk(b"idx1", idx1)
    return chunk(b"RIFF", body)


def _crc_mpeg(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
    return c


def _time_bytes(t, prefix):
    t %= 1 << 33
    return bytes([prefix << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def ts(streams, packets):
    """Transport stream with PAT, PMT and one PES a packet; times in 90 kHz."""
    pid = {s["idx"]: 256 + s["idx"] for s in streams}
    counter: dict[int, int] = {}

    def packet(p, pusi, body, adapt=b""):
        cc = counter[p] = (counter.get(p, -1) + 1) & 15
        room = 184 - len(body) - (len(adapt) + 1 if adapt else 0)
        if room or adapt:
            flags = adapt or b""
            stuff = room if adapt else room - 1
            field = bytes([len(flags) + max(stuff, 0)]) + ((flags or b"\0" * (stuff > 0)) + b"\xff" * (max(stuff, 0) - (0 if flags else stuff > 0)))
            return bytes([0x47, (64 if pusi else 0) | p >> 8, p & 255, 0x30 | cc]) + field + body
        return bytes([0x47, (64 if pusi else 0) | p >> 8, p & 255, 0x10 | cc]) + body

    def section(p, table, ext, body):
        sec = bytes([table]) + struct.pack(">H", 0xB000 | len(body) + 9) + struct.pack(">H", ext) + b"\xc1\0\0" + body
        sec += struct.pack(">I", _crc_mpeg(sec))
        body = b"\0" + sec
        return packet(p, True, body + b"\xff" * (184 - len(body)))

    kinds = {"h264": 0x1B, "aac": 0x0F, "mp3": 0x03}
    es = b"".join(bytes([kinds.get(s["codec"], 6)]) + struct.pack(">HH", 0xE000 | pid[s["idx"]], 0xF000) for s in streams)
    first_pid = next((pid[s["idx"]] for s in streams if s["media_type"] == "video"), min(pid.values()))
    out = [section(0, 0, 1, struct.pack(">HH", 1, 0xE000 | 4096)), section(4096, 2, 1, struct.pack(">HH", 0xE000 | first_pid, 0xF000) + es)]
    tb = {s["idx"]: (s["tb_num"], s["tb_den"], s["media_type"]) for s in streams}
    for idx, pts, dts, _, key, data in packets:
        n, d, kind = tb[idx]
        shown = (pts or 0) * 90000 * n // d
        t = shown if dts is None else dts * 90000 * n // d
        # the time of decoding is written where it differs; the clock follows it
        head = b"\x80\x80\x05" + _time_bytes(shown, 2) if t == shown else b"\x80\xc0\x0a" + _time_bytes(shown, 3) + _time_bytes(t, 1)
        size = len(head) + len(data)
        pes = b"\0\0\1" + (b"\xe0" if kind == "video" else b"\xc0") + struct.pack(">H", size if size < 65536 and kind != "video" else 0) + head + data
        at, start = 0, True
        while at < len(pes):
            adapt = b""
            if start and (key or pid[idx] == first_pid):
                pcr = pid[idx] == first_pid
                adapt = bytes([(64 if key else 0) | (16 if pcr else 0)]) + ((t << 15 | 0x7E00).to_bytes(6, "big") if pcr else b"")
            room = 184 - (len(adapt) + 1 if adapt else 0)
            body = pes[at : at + room]
            out.append(packet(pid[idx], start, body, adapt))
            at += len(body)
            start = False
    return b"".join(out)


def _box(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + name + body


def mp4(streams, packets):
    """Time-interleaved samples with one chunk a run of a track."""
    ps = list(packets)
    tracks = []
    for s in streams:
        own = [p for p in ps if p[0] == s["idx"]]
        scale = s["tb_den"] if s["tb_num"] == 1 and 0 < s["tb_den"] <= 1 << 28 else s.get("sample_rate") or 1000
        pts = [p[1] for p in own]
        if len(own) > 1 and None not in pts and all(a <= b for a, b in zip(pts, pts[1:])) and pts[-1] > pts[0]:
            steps = [b - a for a, b in zip(pts, pts[1:])]
            steps.append(next((x for x in reversed(steps) if x > 0), 1))
        else:
            steps = [max(scale // (50 if s["media_type"] == "audio" else 30), 1)] * len(own)
        tracks.append((s, scale, own, steps))
    order = []
    for t, (_, scale, own, steps) in enumerate(tracks):
        at = 0
        for i, d in enumerate(steps):
            order.append((at / scale, t, i))
            at += d
    order.sort()
    ftyp = _box(b"ftyp", b"isom\0\0\2\0isomiso2mp41")
    body, chunks, last = bytearray(), [[] for _ in tracks], None
    for _, t, i in order:
        if last == t:
            chunks[t][-1][1] += 1
        else:
            chunks[t].append([len(ftyp) + 8 + len(body), 1])
        body += tracks[t][2][i][5]
        last = t
    full = lambda name, *parts: _box(name, b"\0\0\0\0", *parts)
    many = lambda name, rows, fmt: full(name, struct.pack(">I", len(rows)), *[struct.pack(fmt, *r) for r in rows])
    unity = struct.pack(">9I", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)
    traks, longest = b"", 0
    for t, (s, scale, own, steps) in enumerate(tracks):
        video, total = s["media_type"] == "video", sum(steps)
        longest = max(longest, total * 1000 // scale)
        runs: list = []
        for d in steps:
            if runs and runs[-1][1] == d:
                runs[-1][0] += 1
            else:
                runs.append([1, d])
        code = {"h264": b"avc1", "vp9": b"vp09", "opus": b"Opus", "aac": b"mp4a"}.get(s["codec"], b"none")
        if video:
            entry = _box(code, b"\0" * 6, b"\0\1", b"\0" * 16, struct.pack(">HH", s.get("width") or 0, s.get("height") or 0), struct.pack(">IIIH", 0x480000, 0x480000, 0, 1), b"\0" * 32, struct.pack(">Hh", 24, -1))
        else:
            entry = _box(code, b"\0" * 6, b"\0\1", b"\0" * 8, struct.pack(">HHII", s.get("channels") or 0, 16, 0, (s.get("sample_rate") or 0) << 16))
        stsc: list = []
        for c, (_, n) in enumerate(chunks[t], 1):
            if not stsc or stsc[-1][1] != n:
                stsc.append((c, n, 1))
        key = [i + 1 for i, p in enumerate(own) if p[4]]
        stbl = full(b"stsd", struct.pack(">I", 1), entry) + many(b"stts", runs, ">II") + many(b"stsc", stsc, ">III")
        stbl += full(b"stsz", struct.pack(">II", 0, len(own)), *[struct.pack(">I", len(p[5])) for p in own]) + many(b"stco", [(c[0],) for c in chunks[t]], ">I")
        if video and len(key) < len(own):
            stbl += many(b"stss", [(k,) for k in key], ">I")
        hdlr = full(b"hdlr", struct.pack(">I", 0), b"vide" if video else b"soun", b"\0" * 12, b"\0")
        mdia = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, scale, total, 0x55C4, 0)) + hdlr + _box(b"minf", full(b"vmhd", b"\0" * 8) if video else full(b"smhd", b"\0" * 4), _box(b"stbl", stbl))
        tkhd = _box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII", 0, 0, t + 1, 0, total * 1000 // scale), b"\0" * 16, unity, struct.pack(">II", (s.get("width") or 0) << 16, (s.get("height") or 0) << 16))
        traks += _box(b"trak", tkhd, _box(b"mdia", mdia))
    mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, 1000, longest, 65536, 256), b"\0" * 10, unity, b"\0" * 24, struct.pack(">I", len(tracks) + 1))
    return ftyp + _box(b"mdat", bytes(body)) + _box(b"moov", mvhd, traks)


def _cue_text(kind):
    def write(streams, packets):
        def stamp(ms, sep):
            ms = max(ms, 0)
            return f"{ms // 3600000:02}:{ms // 60000 % 60:02}:{ms // 1000 % 60:02}{sep}{ms % 1000:03}"

        out = ["WEBVTT\n\n"] if kind == "vtt" else []
        for i, (_, pts, _, dur, _, data) in enumerate(packets, 1):
            sep = "." if kind == "vtt" else ","
            head = "" if kind == "vtt" else f"{i}\n"
            out.append(f"{head}{stamp(pts, sep)} --> {stamp(pts + dur, sep)}\n{data.decode('utf-8', 'replace').rstrip()}\n\n")
        return "".join(out).encode()

    return write


WRITERS = {
    "wav": wav, "yuv4mpegpipe": y4m, "ivf": ivf, "ogg": ogg, "flac": concat, "mp3": concat, "mp4": mp4, "flv": flv, "avi": avi, "mpegts": ts, "srt": _cue_text("srt"), "webvtt": _cue_text("vtt"),
    "png": first, "jpeg": first, "gif": first, "webp": first, "avif": first, "jpegxl": first,
}


def values(column: pa.Array) -> Iterator:
    """Python values of a column, made for ``ROWS`` of its rows at a time."""
    for at in range(0, len(column), ROWS):
        yield from column.slice(at, ROWS).to_pylist()


def write_files(packets: DataFrame, streams: DataFrame, format_name: str) -> DataFrame:
    """``file, content`` of each output file of ``packets`` and ``streams``.

    Packets are in time order within a file: by start second, stream, ordinal."""
    if format_name not in WRITERS:
        raise FormatError(f"no writer for {format_name}")
    write = WRITERS[format_name]
    names = ["idx", "media_type", "codec", "tb_num", "tb_den", "width", "height", "pixfmt", "color_range", "sample_rate", "channels", "sample_fmt", "extradata"]
    s = streams.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("streams"))
    t = F.coalesce(F.coalesce("dts", "pts") * F.col("tb_num") / F.greatest(F.col("tb_den"), F.lit(1)), F.lit(0.0))
    p = packets.select("file", "idx", "ordinal", "pts", "dts", "duration", "keyframe", "data", t.alias("start")).join(s, "file")
    p = deal(p, "file").sortWithinPartitions("file", "start", "idx", "ordinal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads, rows = None, None, []

        def done():
            return pa.RecordBatch.from_pydict({"file": [now], "content": [write(heads, rows)]}, pa.schema([("file", pa.string()), ("content", pa.binary())]))

        for b in batches:
            at = 0
            for file, *packet in zip(*[values(b.column(c)) for c in ("file", "idx", "pts", "dts", "duration", "keyframe", "data")]):
                if file != now:
                    if rows:
                        yield done()
                    now, heads, rows = file, b.column("streams")[at].as_py(), []
                rows.append(tuple(packet))
                at += 1
        if rows:
            yield done()

    return p.mapInArrow(run, "file string, content binary")
