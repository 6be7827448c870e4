"""Token ids of whole texts by a file of the tokenizers library.

Encoding dominates every job on token ids, and most words of a corpus occur again and again. A text is cut at places where
the tokenizer's own first step always cuts too, which whole columns of texts find at once; each distinct piece is encoded
once per Python worker as long as it is among those kept, and the ids of a text are gathered from those of its pieces.
Texts with white space where that rule does not hold, and tokenizers of another build, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces kept per worker, about 50 bytes each and as many again during a lookup.
MEMO_PIECES = 300_000
#: A lookup of so many times fewer pieces than are known goes without those.
SMALL = 8
#: Pieces encoded by one call.
CALL_PIECES = 256
#: Pieces looked up together, about 60 bytes each.
LOOKUP_PIECES = 1_000_000
#: Texts are encoded together up to this many bytes.
CALL_BYTES = 4_000_000
#: White space beyond single blanks and line feeds: here a byte-level tokenizer may join what lies on both sides.
_ODD_SPACE = re.compile(
    rb"[\x00\t\r\x0b\x0c]|  |\n\n| \n|\n |\A[ \n]|[ \n]\Z|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)
#: By byte: 1 blank or line feed, 2 other white space, 3 first byte of a longer space.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 10]], _KIND[[0, 9, 11, 12, 13]], _KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = 1, 2, 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Between an ASCII letter and one of these marks every tokenizer here cuts.
_STOP, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".,;:!?")] = _LETTER[65:91] = _LETTER[97:123] = True
#: A piece that the first step leaves as it is, so that the tokenizer's model can take it directly.
_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: Byte-level vocabularies write a byte as its printable Latin-1 character, or else as the next free one from 256.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_CHARACTER = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}


class Known:
    """Pieces with their ids, as arrays: the pieces by number, and the ids of all numbers one after the other."""

    def __init__(self):
        self.pieces = pa.array([], pa.large_binary())
        self.ids, self.ends, self.again = np.empty(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, bool)

    def find(self, pieces: pa.LargeBinaryArray) -> np.ndarray:
        """Numbers of pieces, -1 for unknown ones."""
        numbers = pc.index_in(pieces, value_set=self.pieces).fill_null(-1).to_numpy().astype(np.int64)
        self.again[numbers[numbers >= 0]] = True
        return numbers

    def add(self, pieces: pa.LargeBinaryArray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Takes up new, distinct pieces; ``ids`` are those of all of them."""
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.ids, self.ends = np.concatenate((self.ids, ids)), np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        self.again = np.concatenate((self.again, np.zeros(len(pieces), bool)))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some numbers one after the other, and how many each has."""
        firsts = self.ends[numbers]
        sizes = self.ends[numbers + 1] - firsts
        return self.ids[_spans(firsts, sizes)], sizes

    def often(self, most: int) -> Known:
        """Those that were met again since, at most so many."""
        out, kept = Known(), np.flatnonzero(self.again)[:most]
        out.add(self.pieces.take(pa.array(kept)), *self.gather(kept))
        return out


def _spans(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the spans one after the other."""
    ends = np.cumsum(sizes)
    out = np.repeat(firsts - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out


class Encoder:
    """``encode(texts)`` gives for each UTF-8 text its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # the strings of special tokens in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        parts = [p.get("type") for p in before.get("pretokenizers", [])]
        self.kind = "whole"
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not spec.get("normalizer") and not before.get("add_prefix_space"):
            self.kind, self.between = "blank-first", "\n"
        elif parts == ["Split", "ByteLevel"] and steps == ["NFC", "Replace", "Lowercase"]:
            self.kind, self.between = "no-blanks", " \x01 "
        self.memo = Known()
        if self.kind != "whole":
            self.mark = self._whole(self.between.strip(" "))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _split(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces without gaps, where each begins, and the number of the first piece of each text."""
        blank = raw == 32
        if self.kind == "no-blanks":
            blank |= (raw >= 9) & (raw <= 13)
            raw = _LOWER[raw]
            begins = ~blank
            begins[1:] &= blank[:-1]
            begins[bounds[:-1][bounds[:-1] < len(raw)]] = True
            begins &= ~blank
            begins[1:] |= _STOP[raw[1:]] & _LETTER[raw[:-1]]
            raw, begins, before = raw[~blank], begins[~blank], np.concatenate(([0], np.cumsum(~blank)))
            bounds = before[bounds]
        else:
            line = raw == 10
            begins = blank | line
            begins[1:] |= line[:-1] | _STOP[raw[1:]] & _LETTER[raw[:-1]]
            begins[bounds[:-1][bounds[:-1] < len(raw)]] = True
        starts = np.flatnonzero(begins)
        return raw, starts, np.searchsorted(starts, bounds)

    def _odd(self, texts: list[bytes], raw: np.ndarray, bounds: np.ndarray) -> set[int]:
        """Numbers of the texts that have to be encoded whole."""
        if self.kind == "no-blanks" or not len(raw):
            return set()
        kind = _KIND[raw]
        space = kind == 1
        touching = np.flatnonzero(space[1:] & space[:-1])
        inside = bounds[:-1] < bounds[1:]
        edges = np.flatnonzero(inside)[space[bounds[:-1][inside]] | space[bounds[1:][inside] - 1]]
        found = set(edges.tolist()) | set((np.searchsorted(bounds, np.concatenate((touching, np.flatnonzero(kind == 2))), "right") - 1).tolist())
        for i in set((np.searchsorted(bounds, np.flatnonzero(kind == 3), "right") - 1).tolist()) - found:
            if _ODD_SPACE.search(texts[i]):
                found.add(i)
        return found

    def _lookup(self, raw: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive pieces, one after the other, and how many each piece has. Each distinct piece is looked up once."""
        offsets = np.append(starts, end) - starts[0]
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[starts[0] : end])])
        if len(held) * SMALL < len(self.memo.pieces):  # a lookup reads all known pieces, which is not worth it here
            coded = held.dictionary_encode()
            some = Known()
            some.add(*self._learnt(coded.dictionary))
            return some.gather(some.find(coded.dictionary)[coded.indices.to_numpy()])
        if len(self.memo.pieces) > MEMO_PIECES:
            self.memo = self.memo.often(MEMO_PIECES // 2)
        numbers = self.memo.find(held)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            missing = held.take(pa.array(new))
            first = len(self.memo.pieces)
            self.memo.add(*self._learnt(missing.unique()))
            numbers[new] = first + pc.index_in(missing, value_set=self.memo.pieces[first:]).to_numpy()
        return self.memo.gather(numbers)

    def _learnt(self, pieces: pa.LargeBinaryArray) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
        """Distinct pieces in another order, their ids one after the other, and how many each has."""
        order, ids, sizes = self._learn(pieces.to_pylist())
        return pieces.take(pa.array(order)), ids, sizes

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In which order the pieces were encoded, their ids one after the other, and how many each has."""
        texts = b"\n".join(pieces).decode().split("\n")
        if len(texts) > len(pieces):
            texts = [p.decode() for p in pieces]
        plain = np.array([_WORD.fullmatch(t) is not None for t in texts])
        order, ids, sizes = np.flatnonzero(plain).tolist(), [], []
        words = "\n".join([texts[i] for i in order])
        words = (words.lower() if self.kind == "no-blanks" else words).encode().decode("latin-1").translate(_CHARACTER)
        tokenize = self.tokenizer.model.tokenize
        for text in words.split(_CHARACTER[10]) if order else []:
            found = [t.id for t in tokenize(text)]
            ids += found
            sizes.append(len(found))
        parts = [np.array(ids, "<u4")]
        mark, value = self.between.strip(" "), np.frombuffer(self.mark, "<u4")[0]
        rest, alone = [], []
        for i in np.flatnonzero(~plain).tolist():
            (alone if mark in texts[i] else rest).append(i)
        for at in range(0, len(rest), CALL_PIECES):
            some = rest[at : at + CALL_PIECES]
            ids = np.array(self.tokenizer.encode(self.between.join([texts[i] for i in some]), add_special_tokens=False).ids, "<u4")
            marks = ids == value
            ends = np.flatnonzero(marks)
            if len(ends) != len(some) - 1:  # the mark was not kept apart: encode one by one
                alone += some
                continue
            order += some
            parts.append(ids[~marks])
            sizes += (np.diff(ends, prepend=-1, append=len(ids)) - 1).tolist()
        for i in alone:
            parts.append(np.frombuffer(self._whole(texts[i]), "<u4"))
            sizes.append(len(parts[-1]))
        return np.array(order + alone, np.int64), np.concatenate(parts), np.array(sizes, np.int64)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if self.kind == "whole":
            return [self._whole(t.decode()) for t in texts]
        joined = b"".join(texts)
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        raw = np.frombuffer(joined, np.uint8)
        odd = self._odd(texts, raw, bounds)
        if odd:
            plain = [b"" if i in odd else t for i, t in enumerate(texts)]
            joined = b"".join(plain)
            bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))))
            raw = np.frombuffer(joined, np.uint8)
        raw, starts, first = self._split(raw, bounds)
        parts, counts = [b""], [np.zeros(1, np.int64)]
        for at in range(0, len(starts), LOOKUP_PIECES):
            some = starts[at : at + LOOKUP_PIECES]
            ids, each = self._lookup(raw, some, int(starts[at + len(some)]) if at + len(some) < len(starts) else len(raw))
            parts.append(ids.tobytes()), counts.append(each)
        ids, ends = b"".join(parts), 4 * np.cumsum(np.concatenate(counts))[first]
        return [self._whole(t.decode()) if i in odd else ids[a:b] for i, (t, a, b) in enumerate(zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker; Spark reuses workers, so its pieces stay known from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(texts, path: str, end_id: int):
    """Ids with the end id of each text of an iterator, in its order."""
    tool, end, some, size = encoder(path), np.array([end_id], "<u4").tobytes(), [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= CALL_BYTES:
            yield from (ids + end for ids in tool.encode(some))
            some, size = [], 0
    yield from (ids + end for ids in tool.encode(some))
