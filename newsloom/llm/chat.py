"""Chat formatting by columnar byte assembly, and its inverse.

A turn is written as ``<turn:ROLE>TEXT</turn>`` and a newline. Inside roles and texts every ``\\``, ``<`` and
``>`` gets a ``\\`` before it, so no control string can appear there and the escaping is undone exactly. The loss
mask covers the texts of assistant turns.

Assembly works on whole Arrow columns: segment lengths, their running offsets and scatter indices are computed in
numpy and every header, text and trailer is copied once into one preallocated buffer, which becomes the Arrow column.

Defined cases: a null role or text is empty; a null conv_id is a conversation of its own; turns are ordered by
turn (null first), then role, then text, so ties and repeated rows have one order; an empty table gives no rows;
extra columns are ignored. A long conversation is assembled batch by batch as its sorted turns stream in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm._shared import code_points, lean

HEAD, MID, TAIL = b"<turn:", b">", b"</turn>\n"
ESCAPE = ord("\\")
CONTROL = np.zeros(256, bool)
CONTROL[[ESCAPE, ord("<"), ord(">")]] = True
LOSS_ROLE = b"assistant"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
OUT = "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>"


def _column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def _escaped(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with an escape before each control byte, and the new offsets."""
    mark = CONTROL[data]
    shift = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mark, out=shift[1:])
    out = np.full(len(data) + shift[-1], ESCAPE, np.uint8)
    out[np.arange(len(data)) + shift[1:]] = data
    return out, offs + shift[offs]


def _put(out: np.ndarray, at: np.ndarray, data: np.ndarray, offs: np.ndarray) -> None:
    """Copies row i of ``data`` to ``out`` from ``at[i]``."""
    size = np.diff(offs)
    out[np.arange(len(data)) + np.repeat(at - offs[:-1], size)] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns of a batch as bytes: (buffer, offsets of the turns, start and end of each turn's text in code points of the turn)."""
    (role, role_o), (text, text_o) = _escaped(*_column(roles)), _escaped(*_column(texts))
    n, rl, tl = len(roles), np.diff(role_o), np.diff(text_o)
    size = len(HEAD) + rl + len(MID) + tl + len(TAIL)
    offs = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    out = np.empty(offs[-1], np.uint8)
    begin = offs[:-1]
    for bit, at in ((HEAD, begin), (MID, begin + len(HEAD) + rl), (TAIL, begin + size - len(TAIL))):
        out[(at[:, None] + np.arange(len(bit))).ravel()] = np.tile(np.frombuffer(bit, np.uint8), n)
    _put(out, begin + len(HEAD), role, role_o)
    _put(out, begin + len(HEAD) + rl + len(MID), text, text_o)
    start = len(HEAD) + code_points(role, role_o) + len(MID)
    return out, offs, np.stack([start, start + code_points(text, text_o)], 1)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation come in; one row for each conversation goes out once it is complete."""
    open_id: object = None
    open_bytes: list[bytes] = []
    open_spans: list[np.ndarray] = []
    open_points, is_open = 0, False

    def done(ids: list, parts: list[bytes], spans: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary()).cast(pa.string()), pa.array(spans, SPANS)], names=["conv_id", "formatted", "loss_spans"])

    def closed() -> tuple[bytes, list]:
        spans = np.concatenate(open_spans) if open_spans else np.zeros((0, 2), np.int64)
        return b"".join(open_bytes), [{"start": a, "end": b} for a, b in spans.tolist()]

    for batch in batches:
        if not batch.num_rows:
            continue
        buffer, offs, span = assemble(batch["role"], batch["text"])
        ids = batch["conv_id"].to_pylist()
        points = code_points(buffer, offs)
        loss = np.array([r == "assistant" for r in batch["role"].to_pylist()])
        cut = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
        out: tuple[list, list, list] = ([], [], [])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if is_open and ids[a] != open_id:
                x, y = closed()
                for to, v in zip(out, (open_id, x, y), strict=True):
                    to.append(v)
                open_bytes, open_spans, open_points = [], [], 0
            open_id, is_open = ids[a], True
            base = open_points + np.cumsum(points[a:b]) - points[a:b]
            open_bytes.append(buffer[offs[a] : offs[b]].tobytes())
            open_spans.append((span[a:b] + base[:, None])[loss[a:b]])
            open_points += int(points[a:b].sum())
        if out[0]:
            yield done(*out)
    if is_open:
        x, y = closed()
        yield done([open_id], [x], [y])


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (code points of ``formatted``, end exclusive), one row for each conversation."""
    cols = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return cols.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text").mapInArrow(lean(_format), OUT)


def unescape(data: bytes) -> bytes:
    if b"\\" not in data:
        return data
    parts = data.split(b"\\\\")  # escaped escapes first, then the other two
    return b"\\".join(x.replace(b"\\<", b"<").replace(b"\\>", b">") for x in parts)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn. A newline after ``</turn>`` ends a turn; inside, ``<`` is always escaped."""
    turns = []
    for piece in formatted.split(TAIL)[:-1]:
        head, at = piece[len(HEAD) :], 0
        while head[at : at + 1] != MID:
            at += 2 if head[at] == ESCAPE else 1
        turns.append((unescape(head[:at]), unescape(head[at + 1 :])))
    return turns


def digest(formatted: DataFrame) -> DataFrame:
    """Reads conversations back from the formatted output and its mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(batch["conv_id"].to_pylist(), batch["formatted"].to_pylist(), batch["loss_spans"].to_pylist(), strict=True):
                turns = parse(text.encode())
                every, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns:
                    every.update(role + b"\n" + said + b"\n")
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]].encode())
                    loss.update(said)
                    chars += len(said.decode())
                rows.append((conv, len(turns), every.hexdigest(), chars, loss.hexdigest(), len(text)))
            if rows:
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return formatted.mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
