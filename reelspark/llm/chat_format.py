"""Chat formatting with a grammar round trip.

A turn is rendered as ``### <role>: <text> </turn>`` and a line feed.  The
rendered turn is parsed again by a deterministic parser; where the recovered
turn differs from the source, its control strings are escaped by one more
backslash, until it is identical.

Grammar (``n >= 0`` backslashes before a control string)::

    conversation = turn*
    turn         = "### " role ": " content " </turn>" LF
    role         = ( A-Z a-z 0-9 _ . - | "%" hex hex )*
    content      = any text; "###" and "</turn>" in it stand behind at least one
                   backslash, of which the parser takes one away
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_rows

_HEAD = re.compile(r"### ([A-Za-z0-9_.%-]*): ")
_CONTROL = re.compile(r"(\\*)(###|</turn>)")
_TAIL = " </turn>\n"
_ROLE_CHAR = re.compile(r"[^A-Za-z0-9_.-]")


class GrammarError(ValueError):
    """The text is not a sequence of turns."""


def _role_out(role: str) -> str:
    return _ROLE_CHAR.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), role)


def _role_in(name: str) -> str:
    raw = re.sub(rb"%([0-9A-F]{2})", lambda m: bytes.fromhex(m[1].decode()), name.encode())
    return raw.decode("utf-8", "surrogatepass")


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of ``text``; start and end enclose
    its content as it stands in ``text``."""
    turns, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        if not head:
            raise GrammarError(f"no turn at {at}")
        start = pos = head.end()
        parts = []
        while True:
            m = _CONTROL.search(text, pos)
            if not m:
                raise GrammarError(f"turn at {at} does not end")
            if m[1]:
                parts.append(text[pos : m.start()] + m[0][1:])
                pos = m.end()
                continue
            end = m.start() - 1
            if m[2] != "</turn>" or end < pos or not text.startswith(_TAIL, end):
                raise GrammarError(f"stray {m[2]} at {m.start()}")
            parts.append(text[pos:end])
            turns.append((_role_in(head[1]), "".join(parts), start, end))
            at = end + len(_TAIL)
            break
    return turns


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def render_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """(rendered turn, start and end of its content); null counts as empty."""
    role, text = role or "", text or ""
    head = f"### {_role_out(role)}: "
    content = text
    while True:
        out = head + content + _TAIL
        try:
            if [t[:2] for t in parse(out)] == [(role, text)]:
                return out, len(head), len(head) + len(content)
        except GrammarError:
            pass
        if content != text:
            raise AssertionError("escaping did not make the turn identical")
        content = escape(text)


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` as rendered turns: ``conv_id, turn, role,
    rendered, content_start, content_end, trained`` (loss is taken inside the
    content of assistant turns).  Rows are independent, so a conversation of any
    length is rendered in parallel.

    Null texts and roles are empty; null ids and turns stay null; repeated rows
    repeat; an empty table gives an empty result; extra columns are ignored.
    """
    src = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )

    def make():
        def step(batch):
            role, text = batch.column("role").to_pylist(), batch.column("text")
            out = [render_turn(r, text[i].as_py()) for i, r in enumerate(role)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), batch.column("turn"), batch.column("role"),
                    pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()),
                    pa.array([o[2] for o in out], pa.int64()), pa.array([r == "assistant" for r in role], pa.bool_()),
                ],
                ["conv_id", "turn", "role", "rendered", "content_start", "content_end", "trained"],
            )

        return step

    return map_rows(src, make, "conv_id bigint, turn bigint, role string, rendered string, content_start bigint, content_end bigint, trained boolean")


class _ReadBack:
    """What is read from the rendered turns of one conversation, one at a time."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.turns = self.loss = self.chars = 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str, trained: bool) -> None:
        self.chars += len(rendered)
        for role, text, _, _ in parse(rendered):
            self.turns += 1
            self.turns_hash.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if trained:
                self.loss += len(text)
                self.loss_hash.update(text.encode("utf-8", "surrogatepass"))

    def row(self):
        return (self.conv_id, self.turns, self.turns_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars)


READ_BACK = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its rendered turns.

    Turns follow each other by turn (null first), then role and rendered text.
    Rows are sorted within their partition and streamed with one conversation's
    running digests in memory, so its length does not matter.  Rows with a null
    ``conv_id`` are one conversation with a null id.
    """
    dealt = formatted.select("conv_id", "turn", "role", "rendered", "trained").repartition("conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "role", "rendered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def flush():
            cols = list(zip(*done))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            done.clear()
            return out

        for batch in batches:
            text, trained = batch.column("rendered"), batch.column("trained").to_pylist()
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _ReadBack(conv)
                now.add(text[i].as_py(), trained[i])
            if len(done) >= 1000:
                yield flush()
        if now is not None:
            done.append(now.row())
            yield flush()

    return dealt.mapInArrow(run, READ_BACK)
