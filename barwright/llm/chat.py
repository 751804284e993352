"""Conversations as training text: columnar byte assembly with numpy, and its exact inverse.

A turn is `### {role} <turn>\\n{text}</turn>\\n`. Inside roles and texts a backslash becomes \\b, < becomes \\l and # becomes \\h, so no
mark can occur in them. Lengths, cumulative offsets and scatter positions are computed for all turns of a batch at
once, and every byte is copied once into one preallocated buffer, which becomes the Arrow column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import slices

OPEN, AFTER_ROLE, CLOSE = b"### ", b" <turn>\n", b"</turn>\n"
_CODES = {b"\\": b"\\b", b"<": b"\\l", b"#": b"\\h"}
_ESCAPED, _LETTER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
for _plain, _code in _CODES.items():
    _ESCAPED[_plain[0]], _LETTER[_plain[0]] = True, _code[1]
#: From this mean length on, segments are copied one by one: position arrays would take many times their bytes.
LONG = 1 << 16

SCHEMA = "conv_id {0}, part int, last boolean, n_turns long, formatted string, loss array<struct<start: long, stop: long>>"


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and its offsets, null as empty."""
    column = pa.array(column.fill_null(""), pa.string()) if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _escaped(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = _bytes(column)
    if len(data) >= LONG * len(column):
        parts = []
        for start, stop in zip(offsets[:-1], offsets[1:], strict=True):
            part = data[start:stop].tobytes()
            for plain, code in _CODES.items():
                part = part.replace(plain, code)
            parts.append(part)
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    mark = _ESCAPED[data]
    shift = np.concatenate(([0], np.cumsum(mark)))
    out = np.full(len(data) + shift[-1], ord("\\"), np.uint8)
    out[np.arange(len(data)) + shift[1:]] = _LETTER[data]
    return out, offsets + shift[offsets]


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy segment i of data to out from at[i] on."""
    sizes = np.diff(offsets)
    if len(data) >= LONG * len(sizes):
        for where, start, size in zip(at, offsets, sizes, strict=False):
            out[where : where + size] = data[start : start + size]
    else:
        out[np.repeat(at - offsets[:-1], sizes) + np.arange(len(data))] = data


def _points(out: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many code points begin before each of the ascending places `at`, all of them within `out`."""
    if not len(at):
        return np.zeros(0, np.int64)
    counts = np.add.reduceat((out & 0xC0) != 0x80, np.concatenate(([0], at)), dtype=np.int64)[:-1]
    counts[np.diff(np.concatenate(([0], at))) == 0] = 0
    return np.cumsum(counts)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer of all turns one after another, the turns' offsets in it, and where each escaped text begins and ends."""
    role, role_at = _escaped(roles)
    text, text_at = _escaped(texts)
    fixed = len(OPEN) + len(AFTER_ROLE) + len(CLOSE)
    sizes = np.diff(role_at) + np.diff(text_at) + fixed
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(at[-1], np.uint8)
    starts = at[:-1]
    role_start = starts + len(OPEN)
    role_end = role_start + np.diff(role_at)
    begin = role_end + len(AFTER_ROLE)
    end = begin + np.diff(text_at)
    for mark, where in ((OPEN, starts), (AFTER_ROLE, role_end), (CLOSE, end)):
        out[where[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(out, role_start, role, role_at)
    _scatter(out, begin, text, text_at)
    return out, at, begin, end


def format_chat(turns: DataFrame, trained_role: str = "assistant", part_bytes: int = 8 << 20) -> DataFrame:
    """conv_id, part, last, n_turns, formatted, loss: each conversation's text, in parts of whole turns.

    Rows are taken by turn, ties by role and then text, nulls first and as empty; a null conv_id is a conversation of its own,
    repeated rows are turns of their own, an empty table gives no rows; conv_id may be of any type that can be sorted, other columns are not read. loss holds the code points of `formatted` under the
    loss mask, one span for each text of `trained_role`. A conversation has one part unless it passes `part_bytes` in a
    batch or crosses a batch: then its parts follow each other, and the last one says so. Rows stream through a sorted
    partition, so a conversation with a third of all rows needs no more memory than any other.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()
    trained = trained_role.encode()

    def build(batches):
        held = None  # the last conversation's parts wait until it is known whether it goes on
        for batch in slices(batches, 4096):
            conv, roles = batch.column("conv_id"), batch.column("role")
            n = len(conv)
            out, at, begin, end = assemble(roles, batch.column("text"))
            places = _points(out, np.stack((at[:-1], begin, end), axis=1).ravel()).reshape(-1, 3)
            names = np.array(conv.to_pylist(), object)
            new = np.concatenate(([True], names[1:] != names[:-1])) if n else np.zeros(0, bool)
            size = at[:-1] // part_bytes
            edges = np.flatnonzero(new | np.concatenate(([False], size[1:] != size[:-1])))
            learned = np.array([r == trained for r in (x.encode() for x in roles.to_pylist())], bool)
            for first, stop in zip(edges, [*edges[1:], n], strict=True):
                base = places[first, 0]
                spans = [{"start": int(places[i, 1] - base), "stop": int(places[i, 2] - base)} for i in range(first, stop) if learned[i]]
                row = [names[first], 0, True, int(stop - first), out[at[first] : at[stop]].tobytes().decode(), spans]
                if held is not None:
                    held[2] = not (held[0] == row[0])
                    row[1] = 0 if held[2] else held[1] + 1
                    yield _batch(held, conv.type)
                held = row
        if held is not None:
            yield _batch(held, conv.type)

    return ordered.mapInArrow(_gathered(build), SCHEMA.format(kind))


def _batch(row: list, conv_type: pa.DataType) -> pa.RecordBatch:
    conv, part, last, n, text, spans = row
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.record_batch([pa.array([conv], conv_type), pa.array([part], pa.int32()), pa.array([last]), pa.array([n], pa.int64()), pa.array([text]), pa.array([spans], span)], names=["conv_id", "part", "last", "n_turns", "formatted", "loss"])


def _gathered(build, rows: int = 512, size: int = 16 << 20):
    """Single rows joined to batches of some hundred rows or some MB."""

    def run(batches):
        waiting, total = [], 0
        for one in build(batches):
            waiting.append(one)
            total += one.nbytes
            if len(waiting) >= rows or total >= size:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, total = [], 0
        if waiting:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    return run


def unescape(text: str) -> str:
    """What stood in the text before escaping."""
    return text.replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted part."""
    turns = (turn[len(OPEN) :].split(AFTER_ROLE.decode(), 1) for turn in formatted.split(CLOSE.decode())[:-1])
    return [(unescape(role), unescape(text)) for role, text in turns]
