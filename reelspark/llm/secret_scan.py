"""Secret scan with a recursive decoding worklist.

Every layer of a text is scanned.  A layer yields further layers: the text with
its percent and Unicode escapes decoded, and each base64 stretch decoded and, if
it is compressed, inflated.  A stretch may be wrapped over lines and may start
anywhere among other characters of the alphabet, so it is decoded at all four
alignments, and compressed data is looked for at each of its characters; bytes
that are not UTF-8 are scanned one by one.  Layers are unwrapped until nothing
new appears; a layer that was seen before at the same place of the original text
is a cycle and is not entered again, while equal layers at other places are.
Each layer carries for each of its code points the span of the original text it
came from.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_rows

#: Kinds in the order in which they are listed at equal starts.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ASSIGN_HEADS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_B64 = np.zeros(256, bool)
_B64[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")] = True
_B64_OR_BLANK = _B64.copy()
_B64_OR_BLANK[list(b" \t\r\n")] = True
_ESCAPE = re.compile(r"((?:%[0-9A-Fa-f]{2})+)|((?:\\u[0-9A-Fa-f]{4})+)|((?:\\x[0-9A-Fa-f]{2})+)")
_SHORTEST_B64 = 16
_LINE_END = re.compile(rb"[\r\n][ \t\r\n]*")
#: How gzip, zlib, bzip2 and xz data begin in base64.
_PACKED = re.compile(rb"H4sI|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]|Qlpo[MNO]|[/_]Td6W")
#: Bytes without any of these hold no secret and no further layer.
_PROMISING = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{32}|[A-Za-z0-9+/_-]{16}|%[0-9A-Fa-f]{2}|\\[ux]|[\r\n]")
#: The shortest secret: a five-letter name, a sign and a value of eight.
_SHORTEST_SECRET = 14
#: Blanks around a line end, and what base64 goes on with.
_GAP = re.compile(rb"(?<![ \t])[ \t]*[\r\n][ \t\r\n]*")
_BLANKS = b" \t\r\n"
_B64_RUN = re.compile(rb"[A-Za-z0-9+/_-]*")
#: A compressed layer is inflated and scanned in pieces of this many bytes, each
#: with the last ones of the piece before it, so that memory stays bounded.  What
#: a piece leaves open (compressed data inside compressed data) is read on from
#: the layer itself, which is inflated anew for it, past the piece's end.
INFLATE_BYTES = 16 << 20
INFLATE_OVERLAP = 4 << 20
_DECODE_CHARS = 1 << 16


def _runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    off = np.flatnonzero(~mask)
    edge = np.concatenate(([-1], off, [len(mask)]))
    at = np.flatnonzero(np.diff(edge) > least)
    return [(int(edge[i]) + 1, int(edge[i + 1])) for i in at]


def base_spans(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes of UTF-8 ``data``, leftmost and not
    overlapping within a kind."""
    out = []
    low = data.lower()
    heads = []
    for head in _ASSIGN_HEADS:
        at = low.find(head)
        while at >= 0:
            heads.append(at)
            at = low.find(head, at + 1)
    done = 0
    for at in sorted(heads):
        if at >= done and (m := _ASSIGN.match(low, at)):
            done = m.end()
            if done - m.start(2) >= 8:
                out.append((at, done, "assign"))
    at = data.find(b"AKIA")
    while at >= 0:
        m = _ACCESS.match(data, at)
        end = m.end() if m else at + 1
        if m and end - at >= 16:
            out.append((at, end, "access"))
        at = data.find(b"AKIA", end)
    if len(data) >= 32:
        out += [(a, b, "hex") for a, b in _runs(_HEX[np.frombuffer(data, np.uint8)], 32)]
    return out


def _decode_base64(part: bytes) -> bytes:
    """The bytes of whole and begun groups of four; a lone last character holds
    no byte."""
    part = part.replace(b"-", b"+").replace(b"_", b"/")
    if len(part) % 4 == 1:
        part = part[:-1]
    return base64.b64decode(part + b"=" * (-len(part) % 4))


def _engine(raw: bytes):
    """A decompressor for data that begins like ``raw``, else None."""
    if raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _slices(part: bytes):
    for at in range(0, len(part), _DECODE_CHARS):
        yield part[at : at + _DECODE_CHARS]


def _decoded(chars):
    """The bytes of base64 characters that come in chunks of any length."""
    held = b""
    for chunk in chars:
        held += chunk
        whole = len(held) // 4 * 4
        yield _decode_base64(held[:whole])
        held = held[whole:]
    if held:
        yield _decode_base64(held)


def _inflated(chars):
    """The content of the gzip, zlib, bzip2 or xz data with whose base64 the
    chunks ``chars`` begin, all members of it, as blocks of at most
    ``INFLATE_BYTES``; it ends where the data ends or is broken."""
    engine, raw = None, b""
    for more in _decoded(chars):
        raw += more
        if engine is None and len(raw) < 6:
            continue
        while raw or engine is not None:
            engine = engine or _engine(raw)
            if engine is None:
                return
            try:
                block = engine.decompress(raw, INFLATE_BYTES)
            except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError):
                return
            raw = getattr(engine, "unconsumed_tail", b"")
            if block:
                yield block
            if engine.eof:
                engine, raw = None, engine.unused_data.lstrip(b"\0")
                if len(raw) < 6:
                    break
            elif not raw and getattr(engine, "needs_input", not block):
                break


def _inflate(part: bytes, rest, wrapped: bool | None):
    """:func:`_inflated` of a stretch that goes on in ``rest``, if that is given
    and the stretch is open."""
    more = _continued(rest(), wrapped) if rest is not None and wrapped is not None else ()
    return _inflated(chain(_slices(part), more))


def _continued(blocks, wrapped: bool):
    """The base64 characters with which ``blocks`` begin, over line ends if
    ``wrapped``."""
    held = b""
    for block in blocks:
        block = held + block
        if wrapped:
            body = block.rstrip(_BLANKS)
            block, held = _GAP.sub(b"", body), block[len(body) :]
        run = _B64_RUN.match(block)
        yield run[0]
        if run.end() < len(block):
            return


def _pieces(inflate):
    """The blocks of ``inflate()`` gathered into pieces that overlap, each with
    the place at which the layer goes on after it, None at its end.  A piece does
    not end in blanks, unless it has more of them than the overlap."""
    held, size, fresh, done = [], 0, False, 0
    for block in inflate():
        held.append(block)
        size, fresh, done = size + len(block), True, done + len(block)
        if size >= INFLATE_BYTES:
            whole = b"".join(held)
            piece = whole.rstrip(_BLANKS)
            if len(whole) - len(piece) > INFLATE_OVERLAP:
                piece = whole
            blank = len(whole) - len(piece)
            yield piece, done - blank
            held, fresh = [whole[-INFLATE_OVERLAP - blank :]], False
            size = len(held[0])
    if fresh:
        yield b"".join(held), None


def _after(inflate, at: int):
    """What ``inflate()`` gives from byte ``at`` on."""
    for block in inflate():
        if at < len(block):
            yield block[at:]
        at = max(0, at - len(block))


def _leaves_open(piece: bytes) -> bool:
    """Whether compressed data may go on after ``piece``."""
    other = np.flatnonzero(~_B64_OR_BLANK[np.frombuffer(piece, np.uint8)])
    return _PACKED.search(piece, int(other[-1]) + 1 if len(other) else 0) is not None


def _characters(raw: bytes) -> tuple[str, np.ndarray]:
    """``raw`` as text and the bytes of each character: UTF-8, or a character a
    byte where it is not UTF-8."""
    try:
        s = raw.decode("utf-8")
    except UnicodeDecodeError:
        s = raw.decode("latin-1")
        return s, np.ones(len(s), np.int64)
    if len(s) == len(raw):
        return s, np.ones(len(s), np.int64)
    return s, np.array([len(c.encode("utf-8")) for c in s])


def _unescape(text: str):
    """(text with one layer of escapes decoded, first and end code point in
    ``text`` of each of its code points), or None."""
    out, first, end, at = [], [], [], 0
    for m in _ESCAPE.finditer(text):
        if m[1]:
            raw = bytes.fromhex(m[1].replace("%", ""))
            try:
                piece = raw.decode("utf-8")
            except UnicodeDecodeError:
                piece = raw.decode("latin-1")
            width = [3 * len(c.encode("utf-8")) for c in piece] if len(piece) != len(raw) else [3] * len(raw)
        elif m[2]:
            units = bytes.fromhex(m[2].replace("\\u", ""))
            piece = units.decode("utf-16-be", "replace")
            width = [12 if ord(c) > 0xFFFF else 6 for c in piece]
        else:
            piece = bytes.fromhex(m[3].replace("\\x", "")).decode("latin-1")
            width = [4] * len(piece)
        out.append(text[at : m.start()])
        first.append(np.arange(at, m.start())), end.append(np.arange(at, m.start()) + 1)
        stop = np.minimum(m.start() + np.cumsum(width), m.end())
        first.append(np.concatenate(([m.start()], stop[:-1]))), end.append(stop)
        out.append(piece)
        at = m.end()
    if not out:
        return None
    out.append(text[at:])
    first.append(np.arange(at, len(text))), end.append(np.arange(at, len(text)) + 1)
    return "".join(out), np.concatenate(first), np.concatenate(end)


def _code_points(data: bytes, spans):
    """Byte spans as code point spans."""
    if not spans or data.isascii():
        return spans
    before = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[a]), int(before[b]), *rest) for a, b, *rest in spans]


def _stretches(data: bytes, more: bool = False):
    """(characters, code point of each, how it is open) of every base64 stretch
    of ``data``, each line of its own first and then those that go on over line
    ends.  With ``more`` data to follow a stretch at the end is open: False within
    its line, True over line ends; None is not open."""
    raw = np.frombuffer(data, np.uint8)
    point = None if data.isascii() else np.cumsum((raw & 0xC0) != 0x80) - 1
    where = lambda i: i if point is None else point[i]
    for a, b in _runs(_B64[raw], _SHORTEST_B64):
        yield data[a:b], where(np.arange(a, b)), False if more and b == len(raw) else None
    gaps = [m.span() for m in _LINE_END.finditer(data)]
    if not gaps and not more:
        return
    keep = np.ones(len(raw), bool)
    for a, b in gaps:
        while a and data[a - 1] in b" \t":
            a -= 1
        keep[a:b] = False
    index = np.flatnonzero(keep)
    joined = raw[index]
    for a, b in _runs(_B64[joined], _SHORTEST_B64):
        going_on = more and b == len(joined)
        part = joined[a:b].tobytes()
        if index[b - 1] - index[a] >= b - a or going_on and _PACKED.search(part):
            yield part, where(index[a:b]), True if going_on else None


def _mark(s: str):
    return s if len(s) < 64 else hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _layers(layer: str, data: bytes, first, end, rest, seen: set):
    """The layers that ``layer`` (``data`` in UTF-8) yields and that were not seen
    before at their place, made one at a time: text, first and end code point of
    the original of each code point, and for a piece of a longer layer a function
    that gives what follows it, as ``rest`` does for ``layer``."""

    def new(s, f, e, rest=None, at=None):
        if first is not None:
            f, e = first[f], end[e - 1]
        mark = _mark(s), int(f[0]), int(e[-1]), at
        if mark not in seen:
            seen.add(mark)
            yield s, f, e, rest

    if "%" in layer or "\\" in layer:
        if un := _unescape(layer):
            yield from new(*un)
    if len(data) < _SHORTEST_B64:
        return
    for part, at, wrapped in _stretches(data, rest is not None):
        for m in _PACKED.finditer(part):
            inflate = partial(_inflate, part[m.start() :], rest, wrapped)
            for piece, stop in _pieces(inflate):
                t = piece.decode("utf-8", "replace")
                more = None if stop is None else partial(_after, inflate, stop)
                # equal pieces differ if what they leave open does
                yield from new(t, np.broadcast_to(at[m.start()], len(t)), np.broadcast_to(at[-1] + 1, len(t)), more, stop if more and _leaves_open(piece) else None)
        for shift in range(4):
            raw = _decode_base64(part[shift:])
            if len(raw) < _SHORTEST_SECRET or not _PROMISING.search(raw):
                continue
            s, width = _characters(raw)
            stop = np.cumsum(width)
            last = np.minimum(shift + -(-stop // 3) * 4, len(part)) - 1
            yield from new(s, at[shift + (stop - width) // 3 * 4], at[last] + 1)


def scan_text(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each (start, end, kind) in code points of
    ``text``, end exclusive, sorted by start and kind."""
    text = text or ""
    order = {k: i for i, k in enumerate(KINDS)}
    key = lambda s: (s[0], order[s[2]], s[1])
    base: list = []
    found: set = set()
    seen = {(_mark(text), 0, len(text), None)}
    work = [iter([(text, None, None, None)])]
    while work:
        if (top := next(work[-1], None)) is None:
            work.pop()
            continue
        layer, first, end, rest = top
        data = layer.encode("utf-8", "surrogatepass")
        spans = _code_points(data, base_spans(data))
        if first is None:
            base = sorted(spans, key=key)
            found |= set(base)
        else:
            found |= {(int(first[a]), int(end[b - 1]), k) for a, b, k in spans}
        work.append(_layers(layer, data, first, end, rest, seen))
    return base, sorted(found, key=key)


def redact(text: str | None, spans) -> str | None:
    """``text`` with every span, overlapping ones merged, replaced by a mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<secret:{k}>"]
        at = b
    return "".join(out) + text[at:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """``id_col, base, spans`` (arrays of kind, start, end) of every whole text,
    with ``redacted`` also ``redacted_text``.

    Null and empty texts have no spans.  Equal spans of several layers appear
    once; ties in start go by kind as listed.  Repeated rows repeat; a null id
    stays null; extra columns are ignored; an empty table gives an empty result.
    """
    src = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def make():
        def step(batch):
            text = batch.column("text")
            base, spans, red = [], [], []
            for i in range(batch.num_rows):
                t = text[i].as_py()
                b, s = scan_text(t)
                base.append([{"kind": k, "start": x, "end": y} for x, y, k in b])
                spans.append([{"kind": k, "start": x, "end": y} for x, y, k in s])
                red.append(redact(t, s) if redacted else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(base, pa.list_(_SPAN)), pa.array(spans, pa.list_(_SPAN)), pa.array(red, pa.string())],
                ["id", "base", "spans", "redacted_text"],
            )

        return step

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    out = map_rows(src, make, f"id bigint, base {kind}, spans {kind}, redacted_text string")
    return (out if redacted else out.drop("redacted_text")).withColumnRenamed("id", id_col)


def redact_documents(documents: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``documents`` with every secret in ``text_col`` replaced by a mark and
    ``length_col``, where there is such a column, counted anew where a text
    changed; all rows and columns stay, one pass, no shuffle.

    Null and empty texts stay; repeated rows repeat and are redacted alike; a null
    id does not matter; an empty table gives an empty result.
    """
    names = documents.columns

    def make():
        def step(batch):
            text = batch.column(text_col)
            size = batch.column(length_col).to_pylist() if length_col in names else [None] * len(text)
            out = []
            for i in range(batch.num_rows):
                t = text[i].as_py()
                out.append(redact(t, scan_text(t)[1]))
                if out[-1] != t:
                    size[i] = len(out[-1])
            new = {text_col: pa.array(out, text.type)}
            if length_col in names:
                new[length_col] = pa.array(size, batch.column(length_col).type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names)

        return step

    return map_rows(documents, make, documents.schema)
