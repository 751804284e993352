"""Fill-in-middle training texts by piece tables: documents are descriptors over immutable buffers, never edited strings.

A stretch of documents has two buffers, its texts in UTF-8 and the sentinels. A document starts as one descriptor (buffer, start,
size); cutting splits it into prefix, middle and suffix; an arrangement is a permutation of those and the sentinels' descriptors.
Outputs and digests stream through the descriptors; the inverse permutation of what an output holds gives the text back.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import pieces

#: Marks of prefix, suffix and middle in an output.
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
FORMS = (PLAIN, PSM, SPM)
#: Of the six descriptors prefix, middle, suffix, <P>, <S>, <M>: the order in which a form holds them.
ORDERS = np.array([[0, 1, 2, 3, 4, 5], [3, 0, 4, 2, 5, 1], [4, 2, 3, 0, 5, 1]])
#: Descriptors of a form that are part of its output; a plain text has no sentinels.
HELD = np.array([[1, 1, 1, 0, 0, 0], [1] * 6, [1] * 6])

CUT = "form string, n long, prefix_chars long, middle_chars long, output string, output_sha256 string"
RESTORED = "text string, sha256 string"


@dataclass(frozen=True)
class Pieces:
    """Descriptors of some documents, a row each: piece i of row r is buffers[buffer[r, i]] from start[r, i] on, size[r, i] bytes."""

    buffers: tuple[memoryview, ...]
    buffer: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def split(self, place: np.ndarray) -> Pieces:
        """Each row's last piece cut in two at a byte of its buffer."""
        tail = self.start[:, -1] + self.size[:, -1] - place
        size = np.column_stack((self.size[:, :-1], place - self.start[:, -1], tail))
        return Pieces(self.buffers, np.column_stack((self.buffer, self.buffer[:, -1])), np.column_stack((self.start, place)), size)

    def joined(self, other: Pieces) -> Pieces:
        """The pieces of both tables over the same buffers, row by row."""
        return Pieces(self.buffers, *(np.column_stack((getattr(self, x), getattr(other, x))) for x in ("buffer", "start", "size")))

    def permuted(self, order: np.ndarray) -> Pieces:
        return Pieces(self.buffers, *(np.take_along_axis(getattr(self, x), order, axis=1) for x in ("buffer", "start", "size")))

    def parts(self):
        """The rows' pieces as views, a list each; nothing is copied."""
        for row in zip(self.buffer.tolist(), self.start.tolist(), self.size.tolist(), strict=True):
            yield [self.buffers[b][s : s + n] for b, s, n in zip(*row, strict=True) if n]

    def digests(self) -> pa.Array:
        out = []
        for parts in self.parts():
            digest = hashlib.sha256()
            for part in parts:
                digest.update(part)
            out.append(digest.hexdigest())
        return pa.array(out, pa.string())

    def texts(self) -> pa.Array:
        """The rows written out, into one buffer."""
        ends = np.concatenate(([0], self.size.sum(axis=1).cumsum()))
        data, at = bytearray(int(ends[-1])), 0
        for parts in self.parts():
            for part in parts:
                data[at : at + len(part)] = part
                at += len(part)
        return pa.LargeStringArray.from_buffers(len(self.size), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts, null as empty, and the byte at which each begins (and the last ends)."""
    wide = texts.cast(pa.large_string()).fill_null("")
    places = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)
    return data[places[0] : places[-1]], places - places[0]


def _constant(n: int, buffer: int, spans: list[tuple[int, int]], buffers: tuple[memoryview, ...]) -> Pieces:
    start, size = (np.tile(np.array(x, np.int64), (n, 1)) for x in zip(*spans, strict=True))
    return Pieces(buffers, np.full(start.shape, buffer), start, size)


def _cut(texts: pa.Array, keys: list[np.ndarray], sentinels: tuple[str, ...], plain: int, spm: int) -> pa.StructArray:
    data, places = _buffer(texts)
    n_rows, raw = len(texts), data.tobytes()
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first, last = np.searchsorted(lead, places[:-1]), np.searchsorted(lead, places[1:])
    n = last - first
    cuts = np.sort(np.stack((keys[0] % (n + 1), keys[1] % (n + 1))), axis=0)
    byte = np.where(first + cuts < last, np.append(lead, len(data))[np.minimum(first + cuts, len(lead))], places[1:])

    marks = [s.encode() for s in sentinels]
    marked = np.array([any(raw.find(m, a, b) >= 0 for m in marks) for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)], bool)
    form = np.where((n == 0) | marked | (keys[2] % 100 >= 100 - plain), 0, np.where(keys[3] % 100 < spm, 2, 1))

    ends = np.cumsum([0, *map(len, marks)]).tolist()
    buffers = (memoryview(raw), memoryview(b"".join(marks)))
    whole = Pieces(buffers, np.zeros((n_rows, 1), np.int64), places[:-1, None], np.diff(places)[:, None])
    table = whole.split(byte[0]).split(byte[1]).joined(_constant(n_rows, 1, [(ends[i], len(marks[i])) for i in range(3)], buffers))
    table = Pieces(buffers, table.buffer, table.start, table.size * HELD[form]).permuted(ORDERS[form])
    chars = [pa.array(x, pa.int64(), mask=form == 0) for x in (cuts[0], cuts[1] - cuts[0])]
    fields = [pa.array(np.array(FORMS, object)[form], pa.string()), pa.array(n, pa.int64()), *chars, table.texts(), table.digests()]
    return pa.StructArray.from_arrays(fields, names=["form", "n", "prefix_chars", "middle_chars", "output", "output_sha256"])


def _restored(outputs: pa.Array, forms: pa.Array, sentinels: tuple[str, ...]) -> pa.StructArray:
    data, places = _buffer(outputs)
    raw, marks = data.tobytes(), [s.encode() for s in sentinels]
    form = np.array([FORMS.index(f) for f in forms.to_pylist()], np.int64)
    start, size = np.zeros((len(form), 6), np.int64), np.zeros((len(form), 6), np.int64)
    for row, (f, a, b) in enumerate(zip(form.tolist(), places[:-1].tolist(), places[1:].tolist(), strict=True)):
        if f == 0:
            start[row, 0], size[row, 0] = a, b - a
            continue
        # The pieces lie in the form's order; each sentinel ends the text before it.
        at, open_piece = a, -1
        for place, piece in enumerate(ORDERS[f].tolist()):
            if piece < 3:
                open_piece = place
                start[row, place] = at
                continue
            found = raw.find(marks[piece - 3], at, b)
            if found < 0 or (open_piece < 0 and found != a):
                raise ValueError(f"an output of form {FORMS[f]} lacks {sentinels[piece - 3]}")
            if open_piece >= 0:
                size[row, open_piece] = found - at
            start[row, place], at = found, found + len(marks[piece - 3])
        size[row, open_piece] = b - at
    table = Pieces((memoryview(raw),), np.zeros((len(form), 6), np.int64), start, size).permuted(np.argsort(ORDERS[form], axis=1))
    return pa.StructArray.from_arrays([table.texts(), table.digests()], names=["text", "sha256"])


def hashes(doc_id: Column, seed: int = 1) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of `seed:doc_id`, as longs; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, sentinels: tuple[str, ...] = SENTINELS, into: str = "fim") -> DataFrame:
    """docs with a struct column `into`: form, n (code points), prefix_chars, middle_chars, output, output_sha256.

    Two hashes of (seed, doc_id) modulo n + 1 cut each text into prefix, middle and suffix. `plain` percent of the texts, empty
    and null ones and those that hold a sentinel stay as they are (form plain, lengths null); `spm` percent of the others are
    `<S>`suffix`<P>`prefix`<M>`middle, the rest `<P>`prefix`<S>`suffix`<M>`middle. Rows stay in their partitions and are
    handled one by one, so repeated rows and ids have equal results; a null id is hashed as empty. A column `into` is replaced.
    """

    def cut(text: pa.Array, *keys: pa.Array) -> pa.Array:
        out, at = [], 0
        for part in pieces(text):
            own = [k.slice(at, len(part)).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys]
            out.append(_cut(part, own, sentinels, plain, spm))
            at += len(part)
        return pa.concat_arrays(out) if out else _cut(text, [np.zeros(0, np.int64)] * 4, sentinels, plain, spm)

    return docs.withColumn(into, F.arrow_udf(cut, CUT)(F.col("text"), *hashes(F.col("doc_id"), seed)))


def restore(output: Column, form: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """A struct (text, sha256) of the text that an output of this form was made from; an output without its sentinels is an error."""

    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        found, at = [], 0
        for part in pieces(outputs):
            found.append(_restored(part, forms.slice(at, len(part)), sentinels))
            at += len(part)
        return pa.concat_arrays(found) if found else _restored(outputs, forms, sentinels)

    return F.arrow_udf(back, RESTORED)(output, form)
