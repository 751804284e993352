"""Documents as one stream of token ids, cut into sequences of equal length.

First pass: token ids of every document, and each partition's total. Second pass: prefix sums over the totals give every
document its place in the stream, and windows of fixed length cut it; a document across a boundary gives several pieces.
"""

from __future__ import annotations

import re
from array import array
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.common import slices, stored, utf8
from barwright.llm.piece_ids import BLANK, DIGIT, LETTER, MARK, OTHER, Known, Stretch, byte_letters

#: White space or marks at which splitting first could give other ids than the tokenizer does: such texts go to it whole.
_WHOLE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|")
#: Letters whose lower case and normal form are beyond doubt.
_PLAIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: Distinct pieces whose ids a worker keeps from task to task (some 75 MB), and texts that are split at once, of so many bytes if more than one.
PIECES, ROWS, BYTES = 600_000, 1024, 4 << 20
#: A text on which the short cut is tried before it is used.
_PROBE = "Probe: d\xe9j\xe0 vu, \xdcbergr\xf6\xdfe... it's 42%!! a_b x<y\tEND\n(one)two&&& \u2013 fin"
_workers: dict = {}


def _begins(texts: Stretch) -> np.ndarray:
    """Where words begin, each with the white space before it, and the marks that follow a word of plain letters."""
    own, before = texts.classes, texts.before
    begins = (own >= BLANK) & (before < BLANK)
    begins[texts.first] = True
    at = np.flatnonzero(begins)
    if len(at):
        odd = (own == OTHER) | (own == DIGIT) | (texts.bytes == 0x27) | (own == LETTER) & (before == MARK)
        marks = np.flatnonzero((own == MARK) & (before == LETTER))
        begins[marks[~np.logical_or.reduceat(odd, at)[np.searchsorted(at, marks, "right") - 1]]] = True
    return begins


class _Encoder:
    """Ids of texts and the end id, for a tokenizer that drops white space, never joins across it, and parts letters from marks; others get whole texts."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.letters = Tokenizer.from_file(path), end_id, byte_letters()
        self.kind = "<u2" if max(self.tokenizer.get_vocab_size(), end_id) < 1 << 16 else "<u4"
        self.known = Known(self._of_pieces, self.kind, PIECES)
        try:
            self.by_piece = self._by_piece([_PROBE.encode()])[0].tolist() == self._whole(_PROBE).tolist()
        except Exception:  # a model without these parts
            self.by_piece = False

    def _of_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, ends, id_of, model = array("I"), array("q"), attrgetter("id"), self.tokenizer.model
        for piece in pieces:
            word = piece.strip().decode()
            if _PLAIN.fullmatch(word):
                ids.extend(map(id_of, model.tokenize(word.lower().encode().decode("latin-1").translate(self.letters))))
            elif word:
                ids.extend(self.tokenizer.encode(word, add_special_tokens=False).ids)
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(np.array(ends, np.int64), prepend=0)

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray([*self.tokenizer.encode(text, add_special_tokens=False).ids, self.end], self.kind)

    def _by_piece(self, rows: list[bytes], texts: Stretch | None = None) -> list[np.ndarray]:
        texts = texts or Stretch(rows)
        ids, ends = self.known.gathered(*texts.pieces(_begins(texts)), self.end)
        return np.split(ids, ends[:-1])

    def many(self, rows: list[bytes]) -> list[np.ndarray]:
        if not rows:
            return []
        if not self.by_piece:
            return [self._whole(row.decode()) for row in rows]
        texts = Stretch(rows)
        odd = texts.texts_with(np.flatnonzero(texts.classes == OTHER))
        if b"<|" in texts.raw:
            odd |= {i for i, row in enumerate(rows) if b"<|" in row}
        odd = {i for i in odd if _WHOLE.search(rows[i].decode())}
        if not odd:
            return self._by_piece(rows, texts)
        rest = iter(self._by_piece([row for i, row in enumerate(rows) if i not in odd]) if len(odd) < len(rows) else [])
        return [self._whole(row.decode()) if i in odd else next(rest) for i, row in enumerate(rows)]


def _encoder(path: str, end_id: int) -> _Encoder:
    """Kept by the Python worker from task to task."""
    if (path, end_id) not in _workers:
        _workers[path, end_id] = _Encoder(path, end_id)
    return _workers[path, end_id]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """part, at, doc_id, n, ids: each document's ids and the end id, as unsigned little-endian 16 or 32 bits.

    part numbers the task that read the document and at is the number of ids that this task wrote before it. Null texts count
    as empty. The table is stored, so that part and at hold for good.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        from pyspark import TaskContext

        encoder, part, at = _encoder(tokenizer_path, end_id), TaskContext.get().partitionId(), 0
        for batch in slices(batches, ROWS, BYTES):
            rows, places, counts = [], [], []
            for ids in encoder.many(list(utf8(batch.column("text")))):
                rows.append(ids.tobytes())
                places.append(at)
                counts.append(len(ids))
                at += len(ids)
            n = len(rows)
            yield pa.record_batch([pa.array([part] * n, pa.int32()), pa.array(places, pa.int64()), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(rows, pa.binary())], names=["part", "at", "doc_id", "n", "ids"])

    return stored(docs.select("doc_id", "text").mapInArrow(encode, f"part int, at long, doc_id {kind}, n long, ids binary"), "tokens")


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row a piece: doc_id, start, size, ids (binary, unsigned 32 bits little-endian), doc_tokens, sequence_id, offset.

    Every document's ids, ended by `end_id`, lie in the stream exactly once, whatever its length; only the last sequence is
    short. Null and empty texts give the end id alone; repeated rows are packed each on its own; no documents give no pieces.
    """
    tokens = tokenize(docs, tokenizer_path, end_id)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # One row for each task of the first pass: their number, not the documents', bounds this window and the broadcast.
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("first"), "n", "ids")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in slices(batches, 1024):
            owner, start, size, ids, whole, sequence, offset = ([] for _ in range(7))
            for row, (first, n, data) in enumerate(zip(batch.column("first").to_pylist(), batch.column("n").to_pylist(), batch.column("ids"), strict=True)):
                data = data.as_py()
                wide = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4").tobytes()
                at = 0
                while at < n:
                    place = (first + at) % length
                    step = min(length - place, n - at)
                    for column, value in ((owner, row), (start, at), (size, step), (ids, wide[4 * at : 4 * (at + step)]), (whole, n), (sequence, (first + at) // length), (offset, place)):
                        column.append(value)
                    at += step
            longs = [pa.array(c, pa.int64()) for c in (start, size)]
            yield pa.record_batch([batch.column("doc_id").take(pa.array(owner, pa.int64())), *longs, pa.array(ids, pa.binary()), *(pa.array(c, pa.int64()) for c in (whole, sequence, offset))], names=["doc_id", "start", "size", "ids", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(cut, f"doc_id {kind}, start long, size long, ids binary, doc_tokens long, sequence_id long, offset long")

