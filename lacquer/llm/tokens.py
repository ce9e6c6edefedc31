"""Token ids of whole texts by a tokenizers file, with each distinct piece of text encoded once per worker.

Both kinds of vocabulary split a text before any merge, and never merge across a
space behind a visible character or across a change between letters, digits and
punctuation. So a text may be cut there, and its ids are the ids of its pieces,
one after another. Cutting, looking pieces up and putting ids together are array
work; only pieces that the worker doesn't know go to the tokenizer.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import cut, utf8

#: Pieces a worker knows at most; over that it forgets the half that it met longest ago.
REMEMBERED = 1_000_000
#: Pieces of more bytes are encoded each time they come.
LONGEST = 48
_OTHER, _LETTER, _DIGIT, _SIGN, _SPACE, _LINE, _QUOTE = range(7)


def _classes() -> np.ndarray:
    """The class of each byte; control characters and bytes of characters beyond ASCII are other ones."""
    out = np.full(256, _OTHER, np.uint8)
    for b in range(33, 127):
        c = chr(b)
        out[b] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _QUOTE if c == "'" else _SIGN
    out[32], out[10] = _SPACE, _LINE
    return out


_CLASS = _classes()
_VISIBLE = np.array([k in (_LETTER, _DIGIT, _SIGN, _QUOTE) for k in range(7)])
_WORD = np.array([k in (_LETTER, _DIGIT, _SIGN) for k in range(7)])
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 13]] = True


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Classes of the bytes of whole texts; both bytes of the letters from U+00C0 to U+00FF are letters."""
    cls = _CLASS[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    cls[lead] = cls[lead + 1] = _LETTER
    return cls


class Chunks:
    """Pieces of text and their ids. With keeps_blanks a piece has the space before it, otherwise blanks only separate pieces."""

    def __init__(self, path: str, keeps_blanks: bool, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keeps_blanks, self.remembered = Tokenizer.from_file(path), keeps_blanks, remembered
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # between joined pieces stands a mark that is one token and merges with nothing
        self.mark = "\n" if keeps_blanks else " \x01 "
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.known = pa.array([], pa.string())
        self.flat, self.sizes, self.used, self.turn = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All pieces, whether each may be joined to others for the tokenizer, and the n + 1 offsets of the texts among them."""
        data, at = utf8(texts)
        if not len(data):
            return pa.array([], pa.string()), np.zeros(0, bool), np.zeros(len(at), np.int64)
        cls = byte_classes(data)
        for content in self.added:  # a text that spells such a token is one piece
            for i in np.flatnonzero(pc.fill_null(pc.match_substring(texts, content), False)):
                cls[at[i] : at[i + 1]] = _OTHER
        before = np.r_[np.uint8(_OTHER), cls[:-1]]
        edge = (before != cls) & _WORD[before] & _WORD[cls]
        if self.keeps_blanks:
            space = (cls == _SPACE) & _VISIBLE[before]
            wide = np.flatnonzero((cls == _SPACE) & (np.r_[np.uint8(0), data[:-1]] >= 128))
            a, b, c = (data[np.maximum(wide - k, 0)] for k in (3, 2, 1))
            blank = ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0))) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
            space[wide] |= ~blank
            line = (cls == _LINE) & _VISIBLE[before]
            after = np.zeros(len(cls), bool)
            after[1:] = line[:-1] & _VISIBLE[cls[1:]]
            edge |= space | line | after
        else:
            kept = ~_BLANK[data] | (cls == _OTHER) & (data == 32)  # of a text that is one piece, its spaces stay
            edge[1:] |= ~kept[:-1]
        edge[at[:-1][at[:-1] < len(data)]] = True
        if not self.keeps_blanks:
            edge &= kept
            first = np.flatnonzero(edge)
            offsets = np.searchsorted(first, at)
            place = np.cumsum(kept, dtype=np.int32) - 1
            data, cls, first, size = data[kept], cls[kept], place[first], int(kept.sum())
        else:
            first, size = np.flatnonzero(edge), len(data)
            offsets = np.searchsorted(first, at)
        odd = np.append(np.int32(0), np.cumsum((cls == _OTHER) | (cls == _LINE) | (cls == _SPACE), dtype=np.int32))
        edges = np.append(first, size)
        bad = odd[edges[1:]] - odd[first]
        if len(first):
            bad -= cls[first] == _SPACE
            bad[(cls[first] == _SPACE) & (np.diff(edges) == 1)] = 1
        out = pa.StringArray.from_buffers(len(first), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        return out, bad == 0, offsets

    def every_piece(self, texts: pa.Array, most: int = 1 << 20) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """pieces() of about `most` bytes at a time, so that the arrays that cutting takes stay small."""
        found = [self.pieces(part.column(0)) for part in cut(pa.RecordBatch.from_arrays([texts], ["text"]), "text", most)]
        if not found:
            return self.pieces(texts)
        before = np.cumsum([0, *(len(p) for p, _, _ in found[:-1])])
        offsets = np.concatenate([[0], *(o[1:] + b for (_, _, o), b in zip(found, before, strict=True))])
        return pa.concat_arrays([p for p, _, _ in found]), np.concatenate([j for _, j, _ in found]), offsets

    def learn(self, new: pa.Array, joinable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of new pieces, many at a time where they may be joined."""
        n = len(new)
        sizes, found = np.zeros(n, np.int32), [np.zeros(0, np.uint32)] * 2
        order = [np.flatnonzero(joinable), np.flatnonzero(~joinable)]
        if len(order[0]):
            # lists of 256 pieces, each joined into one text
            step = np.arange(0, len(order[0]) + 256, 256).clip(max=len(order[0])).astype(np.int32)
            step = np.unique(step)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(step), new.take(pa.array(order[0]))), self.mark).to_pylist()
            ids, counts = [], []
            for k, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                got = np.array(e.ids, np.uint32)
                marks = np.flatnonzero(got == self.mark_id)
                lo, hi = int(step[k]), int(step[k + 1])
                if len(marks) == hi - lo - 1:
                    counts.append(np.diff(np.r_[-1, marks, len(got)]) - 1)
                    ids.append(np.delete(got, marks))
                else:  # a mark that is a piece, or pieces that aren't as independent as they look
                    alone = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(new.take(pa.array(order[0][lo:hi])).to_pylist(), add_special_tokens=False)]
                    counts.append(np.array([len(x) for x in alone]))
                    ids += alone
            sizes[order[0]], found[0] = np.concatenate(counts), np.concatenate(ids)
        if len(order[1]):
            alone = [x.ids for x in self.tokenizer.encode_batch_fast(new.take(pa.array(order[1])).to_pylist(), add_special_tokens=False)]
            sizes[order[1]] = [len(x) for x in alone]
            found[1] = np.array([i for x in alone for i in x], np.uint32)
        every, by = np.concatenate(found), np.concatenate(order)
        starts = np.empty(n, np.int64)
        starts[by] = np.cumsum(sizes[by]) - sizes[by]
        return gathered(every, starts, sizes), sizes

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null is an empty text), each followed by end_id if there is one, and the n + 1 offsets of the texts."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        pieces, joinable, offsets = self.every_piece(texts)
        coded = pieces.dictionary_encode()
        own, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        where = pc.index_in(own, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.turn += 1
        hit = where[where >= 0]
        self.used[hit] = self.turn
        fresh = np.flatnonzero(where < 0)
        flat, sizes = self.flat, self.sizes
        if len(fresh):
            may = np.zeros(len(own), bool)
            may[at] = joinable
            new = own.take(pa.array(fresh))
            ids, n = self.learn(new, may[fresh])
            where[fresh] = len(sizes) + np.arange(len(fresh))
            flat, sizes = np.concatenate([flat, ids]), np.concatenate([sizes, n])
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        at = where[at]
        out = gathered(flat, starts[at], sizes[at])
        upto = np.r_[0, np.cumsum(sizes[at], dtype=np.int64)][offsets]
        if len(fresh):
            self.remember(new, ids, n)
        if end_id is not None:
            upto = upto + np.arange(len(upto))
            ids, out = out, np.empty(len(out) + len(upto) - 1, np.uint32)
            own_place = np.ones(len(out), bool)
            own_place[upto[1:] - 1] = False
            out[own_place] = ids
            out[~own_place] = end_id
        return out, upto

    def remember(self, new: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        short = pc.binary_length(new).to_numpy() <= LONGEST
        if not short.all():
            ids, new, sizes = ids[np.repeat(short, sizes)], new.filter(pa.array(short)), sizes[short]
        self.known = pa.concat_arrays([self.known, new])
        self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.full(len(new), self.turn, np.int32)])
        if len(self.known) > self.remembered:
            kept = np.sort(np.argsort(-self.used, kind="stable")[: self.remembered // 2])
            starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
            self.flat = gathered(self.flat, starts[kept], self.sizes[kept])
            self.known, self.sizes, self.used = self.known.take(pa.array(kept)), self.sizes[kept], self.used[kept]


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each, one after another."""
    upto = np.cumsum(sizes, dtype=np.int64)
    total = int(upto[-1]) if len(upto) else 0
    return flat[np.repeat(starts - (upto - sizes), sizes) + np.arange(total)]


_made: dict[str, Chunks] = {}


def chunks(path: str, keeps_blanks: bool) -> Chunks:
    """The worker's own encoder for a tokenizers file."""
    if path not in _made:
        _made[path] = Chunks(path, keeps_blanks)
    return _made[path]
