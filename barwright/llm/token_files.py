"""Token ids in compressed binary files, written by tasks in ascending order of documents and read back file by file.

A file is a head, blocks and a tail. Each block holds the ids of some stretch of the stream with the documents they belong to, is
coded on its own (id_coder) and checksummed, so it can be read without the others; a long document runs through several blocks of one
file. Names of files are random and only those that the stored index lists are read, so a task that runs twice does no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm import id_coder
from barwright.llm.common import new_path, slices, stored, utf8
from barwright.llm.piece_ids import BLANK, LETTER, OTHER, SPACE, Known, Spelled, Stretch
from barwright.llm.warc import _filesystem

#: A file is closed at the end of the document with which it reaches so many ids.
FILE_IDS = 256 << 20
#: Texts that are split at once: this many, of so many bytes if that is more than one text.
ROWS, BYTES = 2048, 8 << 20
HEAD, TAIL, TABLE = struct.Struct("<8sI"), struct.Struct("<8sqq"), struct.Struct("<IIII")
MAGIC, END = b"idfile01", b"idend-01"
#: Documents of a block whose id is null.
NO_ID = 0xFFFFFFFF

_PROBE = "Probe: d\xe9j\xe0 vu,  \xdcbergr\xf6\xdfe... it's we'll 42%!!\n\n a_b x<y\tEND\r\n(one) two&&&'s 3x  "
_workers: dict = {}


def _begins(texts: Stretch) -> np.ndarray:
    """Where byte-level tokenizers begin a piece, in texts without OTHER bytes: their pattern is

    '(?:[stmd]|re|ve|ll)| ?letters| ?digits| ?marks|white space before white space or the end|white space
    """
    own, before, after = texts.classes, texts.before, texts.after
    white = own >= BLANK
    # A space goes with what follows it; of several blanks the last one stands apart.
    blank = (before < BLANK) | (after != OTHER) & (after < BLANK)
    begins = np.where(white, blank, (own != before) & (before != SPACE))
    begins[texts.first] = True
    quotes = np.flatnonzero((texts.bytes == 0x27) & begins & (after == LETTER))
    letters = np.append(texts.bytes, np.zeros(2, np.uint8))
    one, two = letters[quotes + 1], letters[quotes + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    long &= after[np.minimum(quotes + 1, len(own) - 1)] == LETTER
    begins[quotes[short | long] + 1] = False
    for ended in (quotes[short] + 2, quotes[long] + 3):
        begins[ended[ended < len(own)]] = True
    return begins


class _Encoder:
    """Ids of texts with the end id, as arrays."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end_id
        self.kind = "<u2" if max(self.tokenizer.get_vocab_size(), end_id) < 1 << 16 else "<u4"
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        try:
            self.known = Known(Spelled(self.tokenizer), self.kind)
            self.by_piece = (self._by_piece([_PROBE.encode()])[0] == self._whole(_PROBE)).all()
        except Exception:  # a model without these parts
            self.by_piece = False

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray([*self.tokenizer.encode(text, add_special_tokens=False).ids, self.end], self.kind)

    def _by_piece(self, rows: list[bytes], texts: Stretch | None = None) -> list[np.ndarray]:
        texts = texts or Stretch(rows)
        ids, ends = self.known.gathered(*texts.pieces(_begins(texts)), self.end)
        return np.split(ids, ends[:-1])

    def many(self, rows: list[bytes]) -> list[np.ndarray]:
        """Texts whose bytes are all of known classes are split by _begins; the others go to the tokenizer whole."""
        if not rows:
            return []
        if not self.by_piece:
            return [self._whole(row.decode()) for row in rows]
        texts = Stretch(rows)
        odd = texts.texts_with(np.flatnonzero(texts.classes == OTHER))
        for special in self.special:
            if special in texts.raw:
                odd |= {i for i, row in enumerate(rows) if special in row}
        if not odd:
            return self._by_piece(rows, texts)
        rest = iter(self._by_piece([row for i, row in enumerate(rows) if i not in odd]))
        return [self._whole(row.decode()) if i in odd else next(rest) for i, row in enumerate(rows)]

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text.encode()])[0]


def _encoder(path: str, end_id: int) -> _Encoder:
    """Kept by the Python worker from task to task."""
    if (path, end_id) not in _workers:
        _workers[path, end_id] = _Encoder(path, end_id)
    return _workers[path, end_id]


class _Writer:
    """One file: documents go in one by one, and blocks go out as they fill."""

    def __init__(self, system, base: str, end_id: int):
        self.name = f"{uuid.uuid4().hex}.ids"
        self.out = system.open_output_stream(f"{base}/{self.name}", compression=None)
        self.out.write(HEAD.pack(MAGIC, end_id))
        self.blocks = self.ids = self.docs = self.waiting = 0
        self.parts: list[np.ndarray] = []
        self.owners: list[tuple[str | None, int]] = []

    def add(self, doc_id: str | None, ids: np.ndarray) -> None:
        self.docs += 1
        self.ids += len(ids)
        while len(ids):
            own = ids[: id_coder.BLOCK - self.waiting]
            ids = ids[len(own) :]
            self.parts.append(own)
            self.owners.append((doc_id, len(own)))
            self.waiting += len(own)
            if self.waiting == id_coder.BLOCK:
                self._block(open_=bool(len(ids)))

    def _block(self, open_: bool) -> None:
        """Table of the documents (numbers of ids, lengths of names, names), its checksum, and the coded ids."""
        names = [None if i is None else i.encode() for i, _ in self.owners]
        sizes = np.array([n for _, n in self.owners], "<u4").tobytes() + np.array([NO_ID if x is None else len(x) for x in names], "<u4").tobytes()
        table = sizes + b"".join(x or b"" for x in names)
        coded = id_coder.encode(np.concatenate(self.parts))
        self.out.write(TABLE.pack(len(names), open_, len(table), zlib.crc32(table)) + struct.pack("<I", len(coded)) + table + coded)
        self.blocks += 1
        self.parts, self.owners, self.waiting = [], [], 0

    def close(self) -> int:
        if self.waiting:
            self._block(open_=False)
        self.out.write(TAIL.pack(END, self.blocks, self.ids))
        size = self.out.tell()
        self.out.close()
        return size


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None, file_ids: int = FILE_IDS) -> tuple[DataFrame, str]:
    """Files of the ids of all docs (doc_id, text), each document ended by end_id; returns the stored index of files and the folder.

    Files are in ascending order of doc_id by (part, no), and so are documents in a file: null ids first, rows of one id in the
    order of a hash of their texts. Null and empty texts give the end id alone; rows that repeat are written each. The index has
    part, no, file, bytes, n_docs, n_ids; an empty table writes no file.
    """
    folder = folder or new_path(docs.sparkSession, "ids")

    def write(batches):
        from pyspark import TaskContext

        ids_of, part = _encoder(tokenizer_path, end_id), TaskContext.get().partitionId()
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        writer, rows = None, []

        def closed(writer):
            return {"part": part, "no": len(rows), "file": writer.name, "bytes": writer.close(), "n_docs": writer.docs, "n_ids": writer.ids}

        for batch in slices(batches, ROWS, BYTES):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of.many(list(utf8(batch.column("text")))), strict=True):
                writer = writer or _Writer(system, base, end_id)
                writer.add(doc_id, ids)
                if writer.ids >= file_ids:
                    rows.append(closed(writer))
                    writer = None
        if writer:
            rows.append(closed(writer))
        schema = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("file", pa.string()), ("bytes", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        yield from pa.Table.from_pylist(rows, schema).to_batches()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__hash"))
    placed = rows.repartitionByRange("doc_id", "__hash").sortWithinPartitions("doc_id", "__hash")
    index = placed.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(write, "part int, no int, file string, bytes long, n_docs long, n_ids long")
    return stored(index, "ids-index"), folder


def _exactly(source, n: int, name: str) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise ValueError(f"{name} ends too early")
    return data


def _documents(source, name: str):
    """(doc_id, ids of one stretch, whether the document ends with it) of a file, block by block, its tail checked."""
    if HEAD.unpack(_exactly(source, HEAD.size, name))[0] != MAGIC:
        raise ValueError(f"{name} is no file of ids")
    blocks = total = 0
    while True:
        head = _exactly(source, TAIL.size, name)
        if head.startswith(END):
            if TAIL.unpack(head)[1:] != (blocks, total) or source.read(1):
                raise ValueError(f"{name} does not hold what its tail says")
            return
        n, open_, size, crc = TABLE.unpack_from(head)
        (coded,) = struct.unpack_from("<I", head, TABLE.size)
        # The head of a block is shorter than a tail.
        rest = head[TABLE.size + 4 :]
        body = rest + _exactly(source, size + coded - len(rest), name)
        table = body[:size]
        if zlib.crc32(table) != crc:
            raise ValueError(f"a table of documents in {name} is damaged")
        counts, lengths = np.frombuffer(table, "<u4", 2 * n).reshape(2, n)
        ids = id_coder.decode(body[size:])
        at, place = 0, 8 * n
        for i, (count, length) in enumerate(zip(counts.tolist(), lengths.tolist(), strict=True)):
            doc_id = None
            if length != NO_ID:
                doc_id = table[place : place + length].decode()
                place += length
            yield doc_id, ids[at : at + count], not (open_ and i == n - 1)
            at += count
        blocks += 1
        total += at


def read_tokens(index: DataFrame, folder: str, id_type: str = "long", with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of every document in the files that the index lists.

    start counts the ids of all documents before it, n_tokens its own with the end id; ids (binary, unsigned 32 bits little-endian)
    is null unless with_ids, and then only one block is held at a time. Files of equal rank are read by tasks of their own.
    Damaged blocks and files that are cut short are errors. An empty index gives no rows.
    """
    n_files = max(1, index.count())
    # One row a file: their number bounds this window.
    before = F.sum("n_ids").over(Window.orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1))
    placed = index.select("part", "no", "file", F.coalesce(before, F.lit(0)).alias("base")).repartitionByRange(n_files, "part", "no")

    def read(batches):
        system, base = _filesystem(folder)
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for name, at in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows: list[list] = [[], [], [], [], []]
                n = crc = held = 0
                kept: list[bytes] = []
                with system.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for doc_id, ids, ends in _documents(source, name):
                        n += len(ids)
                        crc = zlib.crc32(np.ascontiguousarray(ids), crc)
                        if with_ids:
                            kept.append(ids.tobytes())
                        if ends:
                            for column, value in zip(rows, (doc_id, at, n, crc, b"".join(kept) if with_ids else None), strict=True):
                                column.append(value)
                            at += n
                            held += n if with_ids else 4
                            n, crc, kept = 0, 0, []
                            if held > 1 << 20:
                                yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)
                                rows, held = [[], [], [], [], []], 0
                yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)

    found = placed.mapInArrow(read, "doc_id string, start long, n_tokens long, ids_crc32 long, ids binary")
    return found.withColumn("doc_id", F.col("doc_id").cast(id_type))
