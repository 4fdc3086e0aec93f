"""Byte-level BPE by dynamic programming over prefixes.

The BPE encoding of a byte string ends in one token, and what stands before that token is the
encoding of the shorter prefix.  So a string's encodings of all prefixes fit in one array:
``last[i]`` is the last token of the encoding of the first i bytes.  A vocabulary token that
is a suffix of the prefix is the right one if it may follow ``last`` of what is left: two
tokens may stand side by side if the encoding of their joined bytes is just these two.  Exactly
one token passes.  Appending bytes extends the array; after an edit, the array is kept up to
the edit and extended only until its tokens run as they did before.

Texts are cut by the tokenizer's pattern and each match is encoded by itself; each distinct
piece is encoded once for as long as the worker remembers it (see ``pieces``).  One Arrow
pass, no shuffle; a task holds one slice of text and the remembered pieces.

Defined cases: a null or empty text has no ids; repeated rows are encoded one by one; an
empty table gives an empty result; a very long text is a slice of its own; further columns pass
through, and the operator's own columns replace any of the same name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.llm.pieces import CUT_PATTERN, PieceEncoder, ranges, release, slices

#: What a worker holds: so many pieces, and what a slice of so many bytes is made into (about 280 MB in all).
REMEMBERED, SLICE_BYTES = 250_000, 2 << 20


class PrefixBPE:
    """Encoder and decoder for a vocabulary of byte strings with ranks (which are also the ids)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        #: Whether a token may follow another, by (first + 1) << 32 | second.
        self._pairs: dict[int, bool] = {}
        #: Token id of each suffix of a token, or -1 if the suffix is none itself.
        self._suffixes: dict[bytes, int] = {}
        for token in ranks:
            for k in range(len(token)):
                suffix = token[k:]
                if suffix not in self._suffixes:
                    self._suffixes[suffix] = ranks.get(suffix, -1)

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str) -> PrefixBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})

    def _merged(self, data: bytes) -> list[int]:
        """Encoding of a short string by the merges themselves: lowest rank first, leftmost on a tie."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, first: int, second: int) -> bool:
        key = (first + 1) << 32 | second
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            # first < 0: the start, where a token must be its own encoding
            joined = self.bytes_of[second] if first < 0 else self.bytes_of[first] + self.bytes_of[second]
            found = self._pairs[key] = self._merged(joined) == ([second] if first < 0 else [first, second])
        return found

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Fills ``last`` (which holds as many prefixes as are known) for the prefixes of ``data``."""
        suffixes, pairs, follow = self._suffixes.get, self._pairs.get, self.may_follow
        for end in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            fits = []
            start = end - 1
            while start >= 0 and (token := suffixes(data[start:end])) is not None:
                if token >= 0:
                    fits.append((start, token))
                start -= 1
            for start, token in reversed(fits):  # the longest is most often right
                first = last[start - 1] if start else -1
                fine = pairs((first + 1) << 32 | token)
                if follow(first, token) if fine is None else fine:
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end} of a piece")
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The ids that a prefix array stands for."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None and self.may_follow(-1, whole):
            return [whole]
        return self.walk(self.extend(data, []))

    def edit_piece(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """The piece with bytes start..end replaced, and its prefix array.

        The array is kept before the edit.  After it, once as many entries as the longest token
        equal the old ones, all later ones do: each depends on no more bytes than that.
        """
        edited = data[:start] + new + data[end:]
        longest = max(map(len, self.ranks))
        out, shift, equal = last[:start], len(new) - (end - start), 0
        while len(out) < len(edited):
            self.extend(edited, out, len(out) + 1)
            at = len(out) - 1 - shift
            fresh = len(out) > start + len(new)
            equal = equal + 1 if fresh and 0 <= at < len(last) and last[at] == out[-1] else 0
            if equal >= longest and len(out) - start - len(new) >= 2 * longest:
                out += last[at + 1 :]
        return edited, out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class TextEncoder:
    """Encodes texts by pattern matches, and renders ids."""

    def __init__(self, bpe: PrefixBPE, pattern: str) -> None:
        self.bpe, self.find = bpe, regex.compile(pattern).findall
        self.decimals = [str(i).encode() for i in range(max(bpe.bytes_of, default=-1) + 1)]
        self.texts = PieceEncoder(self.encode_many, limit=REMEMBERED, cuts=pattern == CUT_PATTERN)

    @classmethod
    @lru_cache(maxsize=1)
    def load(cls, ranks_path: str, pattern: str) -> TextEncoder:
        """The encoder of this worker, with what it remembers."""
        return cls(PrefixBPE.load(ranks_path), pattern)

    def encode(self, text: str) -> list[int]:
        """Each match of the pattern by itself."""
        return [i for match in self.find(text) for i in self.bpe.encode_piece(match.encode())]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """Encodes texts whose matches share prefixes, in sorted order, so that shared prefixes are tabled once."""
        found = [self.find(text) for text in texts]
        matches = sorted({m.encode() for ms in found for m in ms})
        made: dict[str, list[int]] = {}
        before, last = b"", []
        for data in matches:
            same = 0
            for a, b in zip(before, data, strict=False):
                if a != b:
                    break
                same += 1
            del last[same:]
            self.bpe.extend(data, last)
            made[data.decode()] = self.bpe.walk(last)
            before = data
        return [[i for m in ms for i in made[m]] for ms in found]

    def digests(self, column: pa.Array) -> tuple[np.ndarray, list[str], list[str], tuple]:
        """Per text: number of ids, sha256 of the decimal ids, sha256 of the bytes that the ids decode to."""
        ids, bounds, codes, offsets = self.texts.pieces(column)
        values, ends = ids.tolist(), bounds.tolist()
        spans = list(zip(ends, ends[1:], strict=False))
        names, parts = list(map(self.decimals.__getitem__, values)), list(map(self.bpe.bytes_of.__getitem__, values))
        decimals = np.empty(len(spans), dtype=object)
        decimals[:] = [b" ".join(names[a:b]) for a, b in spans]
        decoded = np.empty(len(spans), dtype=object)
        decoded[:] = [b"".join(parts[a:b]) for a, b in spans]
        del names, parts, values
        lengths = np.diff(bounds)[codes]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        hexed = lambda data: hashlib.sha256(data).hexdigest()
        filled = codes[lengths > 0]  # an empty piece must not leave a space
        places = np.concatenate([[0], np.cumsum(lengths > 0)])[offsets].tolist()
        of_ids = [hexed(b" ".join(decimals[filled[a:b]].tolist())) for a, b in zip(places, places[1:], strict=False)]
        of_bytes = [hexed(b"".join(decoded[filled[a:b]].tolist())) for a, b in zip(places, places[1:], strict=False)]
        return np.diff(upto[offsets]), of_ids, of_bytes, (ids, bounds, codes, lengths, upto[offsets])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """``docs`` columns other than the text, n_tokens, ids_sha256, decoded_sha256 and, on demand, token_ids.

    The texts are decoded from the ids again, and the digest is of those bytes.
    """
    made = ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids")
    others = [c for c in docs.columns if c != "text" and c not in made]
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in others), "n_tokens long, ids_sha256 string, decoded_sha256 string", *(["token_ids array<int>"] if keep_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.load(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                counts, of_ids, of_bytes, (ids, bounds, codes, lengths, text_bounds) = encoder.digests(part.column("text"))
                columns = {c: part.column(c) for c in others}
                columns |= {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string())}
                if keep_ids:
                    flat = ids[ranges(bounds[:-1][codes], lengths)].astype(np.int32)
                    columns["token_ids"] = pa.ListArray.from_arrays(pa.array(text_bounds, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        release()

    return docs.select(*[F.col(f"`{c}`") for c in others], "text").mapInArrow(run, schema)


def op6(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The contract's columns."""
    return encode_documents(docs.select("doc_id", "text"), ranks_path, pattern)
