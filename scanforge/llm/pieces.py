"""Columnar tokenizing: an exact cut of texts into repeating pieces, and words as codes.

Byte-level BPE tokenizers match a text against a pattern whose matches never run from a
non-space character into a following space: a match may begin with one space or be white
space, but white space after other characters always starts a new match.  The pattern looks
ahead only from white space, so cutting a text before each space that follows a
non-white-space character changes no match.  The pieces repeat far more often than texts do,
so each distinct piece is encoded once and the ids of a text are gathered from its pieces.
For the same reason a piece is cut again, before it is remembered, where an ASCII mark or a
line end follows a letter or digit, and where a line end follows a mark: letters, digits and
marks share no match in this order, and what follows is matched without looking back.

This holds for CUT_PATTERN alone.  An encoder of any other pattern, or one that does more than match and
merge, must say ``cuts=False``; then each distinct text is one piece and nothing is remembered.
"""

from __future__ import annotations

import ctypes
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Everything that any of the regular expression engines in use counts as white space.
_BLANKS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_SPACE_AFTER_BLANK = f"[{_BLANKS}] "
_CUT = re.compile("(?<=[^" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", _BLANKS) + "])(?= )")
_MARKS = r"!-/:-@\[-`{-~"
_FINE = re.compile(rf"(?<=[A-Za-z0-9À-ÖØ-öø-ÿ])(?=[{_MARKS}\n])|(?<=[{_MARKS}])(?=\n)")
#: Fixed value: the one pattern that the cuts are right for.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are handled in slices of about so many bytes.
SLICE_BYTES = 6 << 20


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``limit`` text bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Gives a worker's freed memory back at a task's end, since it may stay idle beside other work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def _plain(column: pa.Array) -> pa.Array:
    return pc.fill_null(column, "")


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def cut(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces, the piece code of each place, and each text's range of places.

    Joining a text's pieces gives the text back.
    """
    texts = _plain(texts)
    odd = pc.match_substring_regex(texts, _SPACE_AFTER_BLANK).to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(texts, " ")
    flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    if odd.any():
        own = [[p if k == 0 else p[1:] for k, p in enumerate(_CUT.split(t))] for t in _strings(texts.filter(pa.array(odd)))]
        lengths = np.diff(offsets)
        keep = np.repeat(~odd, lengths)
        even = np.flatnonzero(keep)
        new_lengths = lengths.copy()
        new_lengths[odd] = [len(x) for x in own]
        new_offsets = np.concatenate([[0], np.cumsum(new_lengths)])
        source = np.empty(new_offsets[-1], dtype=np.int64)
        is_odd = np.repeat(odd, new_lengths)
        source[~is_odd] = even
        source[is_odd] = np.arange(is_odd.sum()) + len(flat)
        extra = pa.array([p for x in own for p in x], type=flat.type)
        flat = pa.concat_arrays([flat, extra]).take(pa.array(source))
        offsets = new_offsets
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2
    firsts = offsets[:-1][np.diff(offsets) > 0]
    codes[firsts] += 1  # a text's first piece has no space before it
    seen = np.zeros(2 * len(coded.dictionary) + 2, dtype=bool)
    seen[codes] = True
    used = np.flatnonzero(seen)
    rank = np.zeros(len(seen), dtype=np.int64)
    rank[used] = np.arange(len(used))
    words = _strings(coded.dictionary)
    return [words[k >> 1] if k & 1 else " " + words[k >> 1] for k in used.tolist()], rank[codes], offsets


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for each pair."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class PieceEncoder:
    """Ids of texts, each distinct fine piece encoded once for as long as it is remembered.

    ``encode``: from pieces to lists of ids.  About ``limit`` fine pieces are remembered; when they are more, those go that were
    seldom met, for most pieces never come again.
    ``whole``: strings that must not be cut; a text that holds one is a piece of its own and is not remembered.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 800_000, cuts: bool = True, whole: tuple[str, ...] = ()) -> None:
        self._encode, self._limit, self._cuts = encode, limit, cuts
        self._whole = re.compile("|".join(map(re.escape, whole))) if whole else None
        self._clear()

    def _uncut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``pieces`` with each distinct text as one piece."""
        coded = _plain(texts).dictionary_encode()
        found = self._encode(_strings(coded.dictionary)) if len(coded.dictionary) else []
        ids = np.fromiter((i for x in found for i in x), dtype=np.uint32, count=sum(map(len, found)))
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int64)
        return ids, bounds, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.arange(len(texts) + 1)

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])
        #: How often each slot was met, halved whenever some are forgotten.
        self.met = np.zeros(0, dtype=np.int32)

    def _forget(self) -> None:
        """Keeps the pieces that were met again, of many the more frequent ones: half the limit at most."""
        least = 2
        while np.count_nonzero(self.met >= least) > self._limit // 2:
            least *= 2
        keep = self.met >= least
        starts = np.array(self.ends, dtype=np.int64)[:-1][keep]
        lengths = np.diff(np.array(self.ends, dtype=np.int64))[keep]
        ids = np.array(self.ids, dtype=np.uint32)[ranges(starts, lengths)]
        self.slots = {p: k for k, p in enumerate(compress(self.slots, keep.tolist()))}  # slots are numbered as they come
        self.ids, self.ends = array("I", ids.tobytes()), array("q", np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64).tobytes())
        self.met = self.met[keep] // 2

    def _fresh(self, pieces: list[str]) -> list[str]:
        return [p for p in dict.fromkeys(pieces) if p not in self.slots]

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct pieces and each piece's range in them; the piece of each place and each text's range of places."""
        if not self._cuts:
            return self._uncut(texts)
        if self._whole and len(texts):
            odd = pc.match_substring_regex(_plain(texts), self._whole.pattern).to_numpy(zero_copy_only=False)
            if odd.any():
                return self._mixed(texts, odd)
        return self._cut(texts)

    def _mixed(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``pieces`` of texts of which those marked ``odd`` are not cut."""
        some = [self._cut(texts.filter(pa.array(~odd))), self._uncut(texts.filter(pa.array(odd)))]
        ids = np.concatenate([x[0] for x in some])
        bounds = np.concatenate([some[0][1], some[1][1][1:] + len(some[0][0])])
        places = np.empty(len(odd), dtype=np.int64)
        n_even = len(some[0][3]) - 1
        places[~odd], places[odd] = np.arange(n_even), n_even + np.arange(odd.sum())
        offsets = np.concatenate([some[0][3], some[0][3][-1] + some[1][3][1:]])
        codes = np.concatenate([some[0][2], some[1][2] + len(some[0][1]) - 1])
        starts, lengths = offsets[:-1][places], np.diff(offsets)[places]
        return ids, bounds, codes[ranges(starts, lengths)], np.concatenate([[0], np.cumsum(lengths)])

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        coarse, codes, offsets = cut(texts)
        fine: list[str] = []
        counts = np.ones(len(coarse), dtype=np.int64)
        for k, piece in enumerate(coarse):
            if piece[1:].isalnum():
                fine.append(piece)
            else:
                parts = _FINE.split(piece)
                fine += parts
                counts[k] = len(parts)
        fresh = self._fresh(fine)
        if self.slots and len(self.slots) + len(fresh) > self._limit:
            self._forget()
            fresh = self._fresh(fine)
        for p, ids in zip(fresh, self._encode(fresh) if fresh else [], strict=True):
            self.slots[p] = len(self.slots)
            self.ids.extend(ids)
            self.ends.append(len(self.ids))
        slots = np.fromiter(map(self.slots.__getitem__, fine), dtype=np.int64, count=len(fine))
        met = np.bincount(slots, minlength=len(self.slots)).astype(np.int32)
        met[: len(self.met)] += self.met
        self.met = met
        ends = np.frombuffer(self.ends, dtype=np.int64)
        ids = np.frombuffer(self.ids, dtype=np.uint32) if len(self.ids) else np.empty(0, dtype=np.uint32)
        starts, lengths = ends[slots], ends[slots + 1] - ends[slots]
        own = ids[ranges(starts, lengths)]
        bounds = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        del ends, ids  # the arrays can't grow while they are viewed
        return own, bounds, codes, offsets

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and each text's range in them."""
        ids, bounds, codes, offsets = self.pieces(texts)
        lengths = np.diff(bounds)[codes]
        return ids[ranges(bounds[:-1][codes], lengths)], np.concatenate([[0], np.cumsum(lengths)])[offsets]


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (runs of other than ASCII white space), the code of each word, and each text's range."""
    texts = _plain(texts)
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # at a text's ends
        real = codes != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return coded.dictionary, codes, offsets
