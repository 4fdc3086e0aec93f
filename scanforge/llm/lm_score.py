"""Language-model scores from a weighted backoff automaton.

Model.  Words are lower-cased (A-Z); each text ends in an end token.  The unigram state gives a
known word ``(1 - a) * c / N`` and every unknown word ``a``, the Good-Turing share of words
seen once.  Every n-gram of up to ORDER words that occurs KEPT times in the training documents is an arc, and
a state if arcs leave it: a state's arcs hold the discounted share of each continuation kept, and its failure
arc the mass left over, which multiplies the next shorter state's probability.  Arcs are interpolated, so each
state's probabilities sum to one.  KEPT is a plain count, so the model grows with the corpus.

Plan.  One pass cuts the texts into chunks of at most CHUNK_BYTES: each is one row with its
tokens as codes into its own dictionary of word hashes and their training counts.  States and arcs are never in
one place: chunks ask for them by hashed key in rounds.  In a round each chunk cuts its ascending distinct keys, with
their counts in the chunk, into parts by key range; each part adds up what all chunks send and answers
every chunk in the order of its keys.  Round 1 asks for the words, round k for the n-grams of order k; those
with a shorter n-gram below KEPT cannot reach KEPT themselves and are not asked for.  Of the chunks that hold a
kept n-gram one is told to own it: it alone adds the n-gram to the sums of its context, which the next round gathers in
the same way.  Last, each chunk builds the part of the automaton that its texts can meet from the answers, and scores them by one
traversal from left to right, which carries the state and takes failure arcs where a state has no arc for the next word.

Defined cases: null or empty texts are the end token alone; a null id hashes as an empty
string; repeated rows count and are scored each; without training documents every word is
unknown; further columns don't matter.  Words and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import written
from scanforge.llm.pieces import slices, words

ORDER = 3
KEPT = 2
DISCOUNT = 0.75
FOLDS, HELD_FOLD = 7, 2
CHUNK_BYTES = 6 << 20
#: Long texts are walked in segments of so many tokens, side by side.
SEGMENT = 128
PART_TOKENS, LEAST_PARTS, MOST_PARTS = 1_000_000, 32, 1 << 14
END = np.uint64(xxhash.xxh64_intdigest(b" end of text"))  # no word holds a space


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_FOLD


@dataclass(frozen=True)
class Automaton:
    """The states and arcs that a chunk's texts can meet, as sorted arrays; state 0 is the empty context.

    ``keys``: ascending state * n_words + word of each arc, ``to`` the state it leads to, ``logs`` its log10 probability.
    ``fail`` and ``fail_logs``: each state's next shorter one, and log10 of the mass left to it.  Every word has an arc from state 0.
    """

    n_words: int
    keys: np.ndarray
    to: np.ndarray
    logs: np.ndarray
    fail: np.ndarray
    fail_logs: np.ndarray
    order: int

    def walk(self, words_: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 probability of each token, by one traversal from left to right that carries the state; ``bounds``: the texts' ranges of tokens.

        Texts are walked side by side, long ones in segments: a state depends on the last order - 1 tokens, so a segment begins
        that many tokens earlier with the empty context.
        """
        parts = -(-np.diff(bounds) // SEGMENT)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, last = np.repeat(bounds[:-1], parts) + nth * SEGMENT, np.repeat(bounds[1:], parts)
        last = np.minimum(first + SEGMENT, last)
        since = np.maximum(first - (self.order - 1), np.repeat(bounds[:-1], parts))
        by = np.argsort(since - last, kind="stable")  # longest first
        first, last, since = first[by], last[by], since[by]
        sizes, state, out = last - since, np.zeros(len(by), dtype=np.int64), np.zeros(len(words_))
        for t in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -t, side="left"))  # those with more than t tokens
            at = since[:n] + t
            word, log, open_ = words_[at], np.zeros(n), np.arange(n)
            while len(open_):
                arc = word[open_]  # state 0 has an arc for every word, in the words' order
                deep = np.flatnonzero(state[open_])
                arc[deep] = _place(self.keys, state[open_[deep]] * self.n_words + arc[deep])
                met = open_[arc >= 0]
                log[met] += self.logs[arc[arc >= 0]]
                state[met] = self.to[arc[arc >= 0]]
                open_ = open_[arc < 0]
                log[open_] += self.fail_logs[state[open_]]
                state[open_] = self.fail[state[open_]]
            own = at >= first[:n]
            out[at[own]] = log[own]
        return out


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), -1)
    by = np.argsort(wanted)  # ascending searches stay in the processor's caches
    asked = wanted[by]
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    out = np.empty(len(wanted), dtype=np.int64)
    out[by] = np.where(keys[at] == asked, at, -1)
    return out


def _chunks(docs: DataFrame) -> DataFrame:
    """One row for each chunk of texts, see the module's text."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                if size + part.nbytes > CHUNK_BYTES and held:
                    yield _coded(held, (task << 24) + k)
                    held, size, k = [], 0, k + 1
                held.append(part)
                size += part.nbytes
        if held:
            yield _coded(held, (task << 24) + k)

    return written(docs.select("doc_id", "text").mapInArrow(code, "chunk long, n_tokens long, ids array<long>, bounds binary, codes binary, hashes binary, counts binary"), "lm-chunks")


def _coded(parts: list[pa.RecordBatch], chunk: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    ids = table.column("doc_id").combine_chunks().cast(pa.int64())
    texts = table.column("text").combine_chunks()
    dictionary, codes, offsets = words(texts, lower=True)
    distinct = dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), dtype=np.uint64, count=len(distinct))
    hashes = np.append(hashes, END)
    bounds = offsets + np.arange(len(offsets))  # an end token after each text
    tokens = np.full(bounds[-1], len(hashes) - 1, dtype=np.int64)
    real = np.ones(len(tokens), dtype=bool)
    real[bounds[1:] - 1] = False
    tokens[real] = codes
    all_counts = np.bincount(tokens, minlength=len(hashes))
    order = np.lexsort((hashes, -all_counts))  # frequent words get small codes; equally frequent ones ascend, so that their differences are small
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    tokens = rank[tokens]
    train = np.repeat([not held_out(i) for i in ids.to_pylist()], np.diff(bounds))
    counts = np.bincount(tokens[train], minlength=len(hashes))
    row = [chunk, len(tokens), ids.to_pylist(), *map(_pack, (bounds, tokens, np.diff(hashes[order], prepend=np.uint64(0)), counts))]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["chunk", "n_tokens", "ids", "bounds", "codes", "hashes", "counts"])


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, of which most are zero, compressed."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _hashes(row: dict) -> np.ndarray:
    return np.cumsum(_unpack(row["hashes"]), dtype=np.uint64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


#: A question or answer: what it is about, the part that answers, the chunk, keys and two columns of numbers.
_TALK = "about int, part int, chunk long, keys binary, a binary, b binary"
_NAMES = ["about", "part", "chunk", "keys", "a", "b"]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
#: About order k: k; about the arcs that leave states of order k: _LEAVING + k; _TOTALS: sums over all words.
_LEAVING, _TOTALS = 100, -1


def _talk(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _KINDS, strict=True)], names=_NAMES)


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of an n-gram from its context's key and its last word's hash."""
    x = (left ^ left >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + (right ^ right >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _ask(about: int, chunk: int, parts: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> list[tuple]:
    """The questions of one chunk, by part; ``keys`` ascend, and so do their parts."""
    of = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    cuts = np.searchsorted(of, np.arange(parts + 1, dtype=np.uint64))
    return [(about, k, chunk, _pack(np.diff(keys[i:j], prepend=np.uint64(0))), _pack(a[i:j]), None if b is None else _pack(b[i:j])) for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if i < j]


def _answer(questions: pa.Table) -> pa.Table:
    """The answers of one part to all chunks about one matter.

    About an order: twice the training count, plus one for the owner.  About leaving arcs: their number and their counts' sum.
    """
    about, part = questions.column("about")[0].as_py(), questions.column("part")[0].as_py()
    chunks = questions.column("chunk").to_pylist()
    each = [np.cumsum(_unpack(k.as_py())) for k in questions.column("keys")]
    keys, first, place = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
    ends = np.cumsum([len(x) for x in each])[:-1]

    def summed(column: str) -> np.ndarray:
        return np.bincount(place, weights=np.concatenate([_unpack(x.as_py()) for x in questions.column(column)])).astype(np.uint64)

    a = summed("a")
    if about > _LEAVING:
        b = summed("b")
        rows = [(about, part, c, None, _pack(x), _pack(y)) for c, x, y in zip(chunks, np.split(a[place], ends), np.split(b[place], ends), strict=True)]
    else:
        told = 2 * a[place]
        told[first] += np.uint64(1)
        rows = [(about, part, c, None, _pack(x), None) for c, x in zip(chunks, np.split(told, ends), strict=True)]
        if about == 1:
            rows.append((_TOTALS, part, -1, None, _pack(np.array([a.sum(), (a > 0).sum(), (a == 1).sum()], dtype=np.uint64)), None))
    return pa.Table.from_batches([_talk(rows)])


class _Level:
    """The distinct n-grams of one order in a chunk that may be kept, and the answers about them.

    ``place``: the n-gram that ends at each token, -1 if none; ``context`` and ``shorter``: the places in the level before of each
    n-gram without its last and without its first word.
    """

    def __init__(self, keys: np.ndarray, place: np.ndarray, context: np.ndarray | None, shorter: np.ndarray | None, own: np.ndarray) -> None:
        self.keys, self.place, self.context, self.shorter, self.own = keys, place, context, shorter, own

    def counted(self, told: np.ndarray) -> None:
        self.n, self.owner = (told >> np.uint64(1)).astype(np.int64), (told & np.uint64(1)).astype(bool)
        self.kept = self.n >= KEPT

    def left(self, number: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The mass that each kept n-gram's failure arc has, 1 for the others."""
        out = np.ones(len(self.keys))
        out[self.kept] -= (total.astype(np.float64) - DISCOUNT * number.astype(np.float64)) / self.n[self.kept]
        return out


class _Chunk:
    """A chunk with all levels that its answers allow, the last of them without answers yet if there are none."""

    def __init__(self, row: dict, answers: pa.Table | None, order: int) -> None:
        self.row, self.chunk = row, row["chunk"]
        self.bounds = _unpack(row["bounds"]).astype(np.int64)
        hashes, tokens = _hashes(row), _unpack(row["codes"]).astype(np.int32)
        self.train = np.repeat([not held_out(i) for i in row["ids"]], np.diff(self.bounds))
        self.first = np.zeros(len(tokens), dtype=bool)
        self.first[self.bounds[:-1]] = True
        self.told: dict[int, list] = {}
        if answers is not None:
            rows = sorted(zip(answers.column("about").to_pylist(), answers.column("part").to_pylist(), answers.column("a"), answers.column("b"), strict=True), key=lambda r: r[:2])
            for about, _, a, b in rows:
                self.told.setdefault(about, []).append((_unpack(a.as_py()), b.as_py()))
        by = np.argsort(hashes)
        rank = np.empty(len(by), dtype=np.int32)
        rank[by] = np.arange(len(by))
        words_ = rank[tokens]
        own = np.bincount(words_[self.train], minlength=len(by))
        self.levels = [_Level(hashes[by], words_, None, None, own)]
        while self._counted() and len(self.levels) < order:
            self.levels.append(self._next(words_))

    def _counted(self) -> bool:
        level, k = self.levels[-1], len(self.levels)
        if k not in self.told and len(level.keys):
            return False
        level.counted(np.concatenate([a for a, _ in self.told.get(k, [])] or [np.empty(0, np.uint64)]))
        return True

    def _next(self, words_: np.ndarray) -> _Level:
        top, k = self.levels[-1], len(self.levels)
        kept = (top.place >= 0) & top.kept[np.maximum(top.place, 0)] if len(top.keys) else np.zeros(len(words_), dtype=bool)
        good = kept & np.r_[False, kept[:-1]] & ~self.first
        at = np.flatnonzero(good)
        context = top.place[at - 1]
        keys, first, place = np.unique(_mix(top.keys[context], self.levels[0].keys[words_[at]]), return_index=True, return_inverse=True)
        places = np.full(len(words_), -1, dtype=np.int32)
        places[at] = place
        return _Level(keys, places, context[first], top.place[at[first]], np.bincount(place[self.train[at]], minlength=len(keys)))

    def leaving(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and the count sums of the arcs that leave the kept n-grams of order ``k``."""
        told = self.told.get(_LEAVING + k, [])
        join = lambda parts: np.concatenate(parts or [np.empty(0, np.uint64)])
        return join([a for a, _ in told]), join([_unpack(b) for _, b in told])

    def questions(self, k: int, order: int, parts: int) -> list[tuple]:
        """Those of round ``k``: the n-grams of order k, and the arcs of those of order k - 2 by their owners."""
        rows = []
        if k <= order:
            rows += _ask(k, self.chunk, parts, self.levels[k - 1].keys, self.levels[k - 1].own)
        if k > 2:
            state, arc = self.levels[k - 3], self.levels[k - 2]
            mine = arc.kept & arc.owner
            number = np.bincount(arc.context[mine], minlength=len(state.keys))
            total = np.bincount(arc.context[mine], weights=arc.n[mine], minlength=len(state.keys)).astype(np.int64)
            rows += _ask(_LEAVING + k - 2, self.chunk, parts, state.keys[state.kept], number[state.kept], total[state.kept])
        return rows

    def automaton(self, unknown: float, n_tokens: int) -> Automaton:
        """The automaton of this chunk's kept n-grams: an arc's probability is its context's mass left times the shorter arc's, plus its own discounted share."""
        order, top = max(len(self.levels), 1), self.levels[0]
        p = np.where(top.n > 0, (1 - unknown) * top.n / max(n_tokens, 1), unknown)
        lasts = np.arange(len(top.keys))
        to, n_states = np.where(top.kept & (order > 1), 1 + np.cumsum(top.kept) - 1, 0), 1 + (int(top.kept.sum()) if order > 1 else 0)
        keys, tos, logs = [lasts], [to], [np.log10(p)]
        fail, fail_logs = [np.zeros(n_states, np.int64)], [np.zeros(1)]
        for k in range(1, len(self.levels)):
            state, arc = self.levels[k - 1], self.levels[k]
            left = state.left(*self.leaving(k))
            fail_logs.append(np.log10(left[state.kept]))
            states, g = to, np.flatnonzero(arc.kept)
            full = np.zeros(len(arc.keys))
            context, shorter = arc.context[g], arc.shorter[g]
            full[g] = left[context] * p[shorter] + (arc.n[g] - DISCOUNT) / state.n[context]
            lasts = lasts[arc.shorter]
            to = np.zeros(len(arc.keys), np.int64)
            if k < order - 1:
                to[g] = n_states + np.arange(len(g))
                fail.append(states[shorter])
                n_states += len(g)
            else:
                to[g] = states[shorter]
            keys.append(states[context] * len(top.keys) + lasts[g])
            tos.append(to[g])
            logs.append(np.log10(full[g]))
            p = full
        whole = np.concatenate(keys)
        by = np.argsort(whole)
        return Automaton(len(top.keys), whole[by], np.concatenate(tos)[by], np.concatenate(logs)[by], np.concatenate(fail), np.concatenate(fail_logs), order)


def _round(chunks: DataFrame, answers: DataFrame | None, k: int, order: int, parts: int) -> DataFrame:
    """The answers of round ``k``."""
    read = chunks.select("chunk", "ids", "bounds", "codes", "hashes")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield _talk(_Chunk(row, None, order).questions(k, order, parts))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_talk(_Chunk(row, right, order).questions(k, order, parts)) for batch in left.to_batches() for row in _rows(batch)] or [_talk([])])

    asked = read.mapInArrow(mapped, _TALK) if answers is None else read.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(met, _TALK)
    return written(asked.groupBy("about", "part").applyInArrow(_answer, _TALK), f"lm-round-{k}")


def answered(docs: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame, int, int, float]:
    """(chunks, what all rounds answered them, training tokens, distinct training words, probability of an unknown word)."""
    chunks = _chunks(docs)
    tokens = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    parts = min(max(-(-tokens // PART_TOKENS), LEAST_PARTS), MOST_PARTS)
    answers = _round(chunks, None, 1, order, parts)
    totals = answers.where(F.col("about") == _TOTALS).select("a").toArrow().column("a")  # one row for each part
    n_tokens, distinct, once = np.sum([_unpack(x.as_py()) for x in totals] or [[0, 0, 0]], axis=0).astype(np.int64).tolist()
    answers = answers.where(F.col("about") != _TOTALS)
    for k in range(2, order + 2 if order > 1 else 2):
        answers = answers.unionAll(_round(chunks, answers, k, order, parts))
    return chunks, answers, n_tokens, distinct, (once + 0.5) / (n_tokens + 1)


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    chunks, answers, n_tokens, distinct, unknown = answered(docs, order)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for batch in left.to_batches():
            for row in _rows(batch):
                own = _Chunk(row, right, order)
                words_, bounds, ids = own.levels[0], own.bounds, row["ids"]
                c = words_.n[words_.place]
                by_doc = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731, B023
                out.append(pa.table({
                    "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held_out(i) for i in ids]), "n_tokens": pa.array(np.diff(bounds)), "n_known": pa.array(by_doc((c > 0).astype(np.int64))),
                    "train_tokens": pa.array(np.full(len(ids), n_tokens, dtype=np.int64)), "base_score": pa.array(by_doc(np.log10((c + 1) / (n_tokens + distinct + 1)))), "score": pa.array(by_doc(own.automaton(unknown, n_tokens).walk(words_.place, bounds))),
                }))
        empty = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_tables(out) if out else empty.empty_table()

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.drop("counts", "n_tokens").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, schema)


def op9(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return score(docs)
