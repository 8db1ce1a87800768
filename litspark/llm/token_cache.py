"""Encoding of short pieces of text with a public tokenizer, each distinct piece once per worker process."""

from __future__ import annotations

import os

import numpy as np

from .common import keep_in_process

MARKS = b".,;:!?*$%#"  # after an ASCII word, both pre-tokenizers used here set a run of these apart
LIMIT = 2_000_000  # pieces a process keeps, some 200 bytes each; a full cache starts anew
_processes: dict = keep_in_process({})


def load_tokenizer(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(text)
    tok.no_truncation()
    tok.no_padding()
    return tok


class PieceCache(dict):
    """Piece (bytes) -> its ids as little-endian unsigned integers of width bytes.

    New pieces are encoded many at a time, joined so that the ids show where each ends: ``starts`` (per id, whether it
    begins a piece, if pieces are joined by their prefix), else ``separator`` (a piece of one id that the pre-tokenizer
    sets apart, with white space around it).  A new piece that is a word with marks after it is put together from both;
    where ``caseless``, an ASCII piece is encoded as its lower case."""

    def __init__(self, tokenizer, prefix: str = "", starts=None, separator: str | None = None, width: int = 4, caseless: bool = False, limit: int = LIMIT):
        super().__init__()
        self.caseless, self.marks, self.limit = caseless, {}, limit
        self.tokenizer, self.prefix, self.starts, self.separator = tokenizer, prefix, starts, separator
        self.dtype = f"<u{width}"
        if separator:
            (self.mark,) = tokenizer.encode(separator, add_special_tokens=False).ids

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast([self.prefix + p.decode() for p in pieces], add_special_tokens=False)
        return [np.array(c.ids, self.dtype).tobytes() for c in coded]

    def encode_joined(self, pieces: list[bytes]) -> list[bytes]:
        """As encode, in one call; None where the ids don't part into as many pieces."""
        glue = self.prefix if self.separator is None else f" {self.separator} "
        text = (self.prefix if self.separator is None else "") + glue.join([p.decode() for p in pieces])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        size = ids.itemsize
        if self.separator is None:
            cuts = np.flatnonzero(self.starts[ids]) * size
            begins, ends = cuts, np.append(cuts[1:], len(ids) * size)
        else:
            cuts = np.flatnonzero(ids == self.mark) * size
            begins, ends = np.append(0, cuts + size), np.append(cuts, len(ids) * size)
        if len(begins) != len(pieces):
            return self.encode(pieces)
        raw = ids.tobytes()
        return [raw[x:y] for x, y in zip(begins.tolist(), ends.tolist())]

    def _marks(self, text: str) -> bytes:
        """Ids of marks that follow a word."""
        if text not in self.marks:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
            if len(self.marks) >= 10_000:
                return ids
            self.marks[text] = ids
        return self.marks[text]

    def fresh(self, unknown: list[bytes]) -> dict:
        """Ids of pieces that the cache lacks; it keeps them while there is room."""
        if self.starts is None and self.separator is None:
            new = {}
            for i in range(0, len(unknown), 4096):
                new.update(zip(unknown[i : i + 4096], self.encode(unknown[i : i + 4096])))
        else:
            stems = [p.rstrip(MARKS) for p in unknown]
            stems = [q if q.isalpha() else p for p, q in zip(unknown, stems)]  # isalpha: ASCII letters only
            if self.caseless:
                stems = [q.lower() if q.isascii() else q for q in stems]
            new = self._encoded([q for q in dict.fromkeys(stems) if q not in self])
            for p, q in zip(unknown, stems):
                if p not in new:
                    ids = new[q] if q in new else self[q]
                    new[p] = ids if len(p) == len(q) else ids + self._marks(p[len(q) :].decode())
        if len(self) + len(new) > self.limit:
            self.clear()
        if len(new) <= self.limit:
            self.update(new)
        return new

    def _encoded(self, words: list[bytes]) -> dict:
        apart, joined = [], words
        if self.separator is not None:
            mark = self.separator.encode()
            apart, joined = [p for p in words if mark in p], [p for p in words if mark not in p]
        new = dict(zip(apart, self.encode(apart)))
        for i in range(0, len(joined), 500):
            part = joined[i : i + 500]
            new.update(zip(part, self.encode_joined(part)))
        return new

    def values(self, lists: list[list[bytes]], fresh=None) -> list[list[bytes]]:
        """Each list's pieces replaced by their ids."""
        out = [list(map(self.get, pieces)) for pieces in lists]
        holes = [i for i, v in enumerate(out) if None in v]
        if holes:
            unknown = {p for i in holes for p, v in zip(lists[i], out[i]) if v is None}
            new = (fresh or self.fresh)(list(unknown))
            for i in holes:
                out[i] = [new[p] if v is None else v for p, v in zip(lists[i], out[i])]
        return out


def process_cache(text: str, name: str = "", **joining) -> PieceCache:
    """The worker process's cache for a tokenizer and a use of it, kept from task to task; joining: PieceCache's other
    arguments, or a function of the tokenizer that gives them."""
    key = (hash(text), name)
    if key not in _processes:
        tokenizer = load_tokenizer(text)
        make = joining.pop("make", None)
        _processes[key] = PieceCache(tokenizer, **(make(tokenizer) if make else joining))
    return _processes[key]


def read_tokenizer(spark, path: str):
    """The tokenizer file's text, broadcast: a vocabulary file of a few MB."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())
