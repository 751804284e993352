"""Token ids of many texts at once: texts are cut into pieces by array operations, and only distinct pieces meet the tokenizer.

The texts of a stretch lie on end in one buffer. Each byte has a class, pieces begin where classes say so, Arrow finds the distinct
pieces, and their ids are gathered from one array that a worker keeps. A piece costs no Python object unless it is new to the stretch.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from itertools import pairwise, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa

#: Distinct pieces that a worker knows at most (some 120 bytes each) before it begins anew, and bytes of a piece that it remembers.
PIECES, LONGEST = 1_300_000, 64
#: Pieces that are new are given to the tokenizer's model this many at once.
TOGETHER = 8
#: No id: the end of such a call.
END = 0xFFFFFFFF
#: Classes of bytes. Letters are A-Z, a-z and, as two bytes, those of Latin-1; what is none of these is OTHER.
OTHER, LETTER, DIGIT, MARK, BLANK, SPACE = range(6)
_WHITE = {*range(0x09, 0x0E)}
_CLASSES = bytes(
    SPACE if c == 0x20 else BLANK if c in _WHITE else LETTER if chr(c).isalpha() and c < 0x80 or c == 0xC3 or 0x80 <= c <= 0xBF else DIGIT if 0x30 <= c <= 0x39 else MARK if 0x21 <= c <= 0x7E else OTHER for c in range(256)
)


class Stretch:
    """Texts on end: their bytes, the class of each byte, and where each text ends."""

    def __init__(self, rows: list[bytes]):
        self.raw = raw = b"".join(rows)
        self.bytes = np.frombuffer(raw, np.uint8)
        self.classes = np.frombuffer(bytearray(raw.translate(_CLASSES)), np.uint8)
        if not raw.isascii():
            lead, second = self.bytes == 0xC3, (self.bytes >= 0x80) & (self.bytes <= 0xBF)
            wrong = second[1:] & (~lead[:-1] | (self.bytes[1:] == 0x97) | (self.bytes[1:] == 0xB7))
            self.classes[1:][wrong] = OTHER
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.ends = sizes.cumsum()
        full = sizes > 0
        self.first, self.last = (self.ends - sizes)[full], self.ends[full] - 1
        self.before, self.after = np.zeros((2, len(raw)), np.uint8)
        self.before[1:], self.after[:-1] = self.classes[:-1], self.classes[1:]
        # OTHER stands for nothing, too, before and after a text.
        self.before[self.first] = self.after[self.last] = OTHER

    def texts_with(self, places: np.ndarray) -> set[int]:
        """The texts in which these places lie."""
        return set(np.searchsorted(self.ends, places, "right").tolist())

    def pieces(self, begins: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pieces that begin where `begins` is set, and for each text how many have begun before its end."""
        begins[self.first] = True
        at = np.flatnonzero(begins)
        offsets = np.append(at, len(self.bytes)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(self.raw)]), np.searchsorted(at, self.ends)


class Known:
    """Piece -> ids, for a function that finds those of many pieces, on end, and their numbers; all ids lie in one array."""

    def __init__(self, ids_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kind: str, most: int = PIECES):
        self.ids_of, self.kind, self.most = ids_of, kind, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.ends = array("H" if self.kind == "<u2" else "I"), array("q", [0])

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        """Where each of these different pieces stands among those whose ids are known; the new ones are learned."""
        if len(self.ends) + len(pieces) > self.most:
            self.clear()
        place = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(place < 0)
        names = [pieces[i] for i in new.tolist()]
        at = len(self.ends) - 1
        ids, sizes = self.ids_of(names)
        self.ends.frombytes((sizes.cumsum() + len(self.ids)).tobytes())
        self.ids.frombytes(ids.astype(self.kind).tobytes())
        place[new] = np.arange(at, at + len(new))
        self.place.update((name, i) for i, name in enumerate(names, at) if len(name) <= LONGEST)
        return place

    def gathered(self, pieces: pa.Array, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, each with the id `end` behind its own, and where each text's ids end.

        ends: where each text's pieces end; texts may have no piece."""
        coded = pieces.dictionary_encode()
        names = coded.dictionary.buffers()[2].to_pybytes() if len(pieces) else b""
        cuts = np.frombuffer(coded.dictionary.buffers()[1], np.int32, len(coded.dictionary) + 1).tolist() if len(pieces) else [0]
        place = self._places([names[a:b] for a, b in pairwise(cuts)])
        stops = np.frombuffer(self.ends, np.int64)
        begins, sizes = stops[place].astype(np.int32), (stops[place + 1] - stops[place]).astype(np.int32)
        which = coded.indices.to_numpy()
        counts = sizes.take(which)
        upto = np.zeros(len(which) + 1, np.int64)
        counts.cumsum(out=upto[1:])
        at = np.repeat(begins.take(which) - upto[:-1].astype(np.int32), counts)
        at += np.arange(upto[-1], dtype=np.int32)
        found = np.frombuffer(self.ids, self.kind).take(at) if len(at) else np.zeros(0, self.kind)
        last = upto[ends]
        return np.insert(found, last, end), last + np.arange(1, len(ends) + 1)


def byte_letters() -> dict[int, int]:
    """Byte -> the code point by which byte-level tokenizers spell it."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {byte: byte if byte in plain else next(others) for byte in range(256)}


class Spelled:
    """Ids of pieces by a byte-level model, several pieces in one call: between them stands a byte that no merge takes in."""

    def __init__(self, tokenizer):
        self.model, self.letters = tokenizer.model, byte_letters()
        vocabulary = tokenizer.get_vocab()
        merged = set("".join(token for token in vocabulary if len(token) > 1))
        apart = [byte for byte, letter in self.letters.items() if byte not in b"\t\n\v\f\r" and byte < 0x20 and chr(letter) in vocabulary and chr(letter) not in merged]
        self.apart, self.together = (bytes(apart[:1]), TOGETHER) if apart else (b"", 1)
        self.mark = vocabulary[chr(self.letters[apart[0]])] if apart else END

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end and how many each piece has; pieces: without control characters other than white space."""
        ids, id_of = array("I"), attrgetter("id")
        for i in range(0, len(pieces), self.together):
            spelt = self.apart.join(pieces[i : i + self.together]).decode("latin-1").translate(self.letters)
            ids.extend(map(id_of, self.model.tokenize(spelt)))
            ids.append(END)
        found = np.frombuffer(ids, np.uint32)
        ends = (found == END) | (found == self.mark)
        return found[~ends], np.diff(np.flatnonzero(ends), prepend=-1) - 1
