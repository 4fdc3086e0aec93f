"""Random forests whose large nodes are split by counts over all tasks and whose smaller nodes are finished by one task each.

A node that more than ``local`` rows reach is split by Spark: tasks count their rows by feature, bin and class, and one group a node
adds up the counts.  The rows of every other node meet in one group of its tree, which grows the node's subtree and takes its rows,
trained or not, to their leaves.  So neither the rows nor the trees are whole in one place, and a node costs what its rows cost.

Every draw is a hash of the row's or the node's key and the seed: the forest is the same however the rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.tables import written

#: Rows of a node that one task finishes, at most; rows whose votes are added up together.
LOCAL, BLOCK = 1 << 16, 1 << 13
#: How often a row is drawn into a tree's sample of as many rows: Poisson with mean 1.
_DRAWN = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(20)])
_VOTES = np.dtype([("row", "<u2"), ("leaf", "<u4")])

Node = tuple[int, int]  # tree and key


def _mix(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers (splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _root(seed: int, tree: int) -> np.ndarray:
    return _mix(_mix(np.array([seed])) + np.uint64(tree))


def _children(keys: np.ndarray) -> np.ndarray:
    """Left and right child of each node, one after the other."""
    return _mix((keys[:, None] ^ _mix(np.arange(2))).ravel())


def _asked(keys: np.ndarray, n_features: int) -> np.ndarray:
    """The features that each node may be split by: the square root of all, rounded up."""
    order = np.argsort(_mix(keys[:, None] + np.arange(1, n_features + 1, dtype=np.uint64)), axis=1)
    return order[:, : math.ceil(math.sqrt(n_features))]


def _drawn(rec: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in the tree's sample; rows without a class never are."""
    u = (_mix(rec["hash"] ^ _root(seed, tree)) >> np.uint64(11)) / 2.0**53
    return np.where(rec["cls"] >= 0, np.searchsorted(_DRAWN, u, "right"), 0).astype(np.uint8)


def _choose(node: np.ndarray, slot: np.ndarray, at: np.ndarray, cls: np.ndarray, n: np.ndarray, nodes: int, slots: int, n_bins: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, bin) of each node's split of the least weighted Gini impurity: bins up to it go left; slot -1 where no split lessens it.

    The other arrays are counts ``n`` of a node's rows by slot, bin and class, in any order and any number of pieces.
    """
    classes = len(weights)
    key = (node * slots + slot) * n_bins + at
    if nodes * slots * n_bins <= 2 * len(key):
        used, where = np.arange(nodes * slots * n_bins), key
    else:
        used, where = np.unique(key, return_inverse=True)
    sums = np.cumsum(np.bincount(where * classes + cls, n, len(used) * classes).reshape(-1, classes), axis=0)
    segment = used // n_bins
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    size = np.diff(np.r_[first, len(used)])
    start = np.vstack([np.zeros((1, classes)), sums])[first]
    whole = np.repeat(sums[first + size - 1] - start, size, 0)
    left = sums - np.repeat(start, size, 0)
    right = whole - left
    gini = lambda c: (c * c).sum(1) / np.maximum(c.sum(1), 1e-300)
    parted = (left.sum(1) > 0) & (right.sum(1) > 0)
    parent = gini(whole * weights)
    gain = np.where(parted, gini(left * weights) + gini(right * weights) - parent, -np.inf)
    owner = segment // slots
    head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    best = np.repeat(np.maximum.reduceat(gain, head), np.diff(np.r_[head, len(used)]))
    taken = np.flatnonzero((gain == best) & (gain > 1e-12 * parent))
    split, which = np.unique(owner[taken], return_index=True)
    found, cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
    found[split], cut[split] = segment[taken[which]] % slots, used[taken[which]] % n_bins
    return found, cut


def _grow(bins: np.ndarray, cls: np.ndarray, n: np.ndarray, key: np.ndarray, level: int, depth: int, n_bins: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of each row and the class counts of each leaf, of the subtree below a node; all its nodes grow level by level."""
    classes, (rows, n_features) = len(weights), bins.shape
    leaf, counts, made = np.zeros(rows, np.int64), [], 0
    live, node, keys = np.arange(rows), np.zeros(rows, np.int64), key
    while len(keys):
        has = n[live] > 0
        trained, at = live[has], node[has]
        total = np.bincount(at * classes + cls[trained], n[trained], len(keys) * classes).reshape(-1, classes)
        open_ = np.flatnonzero(((total > 0).sum(1) > 1) & (level < depth))
        feature, cut = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        if len(open_):
            place = np.full(len(keys), -1)
            place[open_] = np.arange(len(open_))
            trained, at = trained[place[at] >= 0], place[at[place[at] >= 0]]
            asked = _asked(keys[open_], n_features)
            slots = asked.shape[1]
            values = bins[trained[:, None], asked[at]].ravel().astype(np.int64)
            spread = lambda a: np.repeat(a, slots)
            found, cut[open_] = _choose(spread(at), np.tile(np.arange(slots), len(trained)), values, spread(cls[trained]), spread(n[trained]), len(open_), slots, n_bins, weights)
            feature[open_] = np.where(found >= 0, asked[np.arange(len(open_)), found], -1)
        ends = feature < 0
        number = np.where(ends, np.cumsum(ends) - 1 + made, 2 * (np.cumsum(~ends) - 1))
        counts.append(total[ends])
        made += int(ends.sum())
        stays = ends[node]
        leaf[live[stays]] = number[node[stays]]
        live, node = live[~stays], node[~stays]
        keys, level = _children(keys[~ends]), level + 1
        node = number[node] + (bins[live, feature[node]] > cut[node])
    return leaf, np.vstack(counts)


def _votes(block: int, tree: int, rows: np.ndarray, leaf: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> dict:
    """A tree's votes for rows of one block: the class of a pure leaf, or the number of classes plus the place in ``mixed`` of the leaf's shares."""
    classes = len(weights)
    used, which = np.unique(leaf, return_inverse=True)
    counts = counts[used]
    pure = (counts > 0).sum(1) == 1
    code = np.where(pure, counts.argmax(1), classes + np.cumsum(~pure) - 1)
    out = np.empty(len(rows), _VOTES)
    out["row"], out["leaf"] = rows, code[which]
    weighed = counts[~pure] * weights
    shares = weighed / np.maximum(weighed.sum(1, keepdims=True), 1e-300)
    return {"block": block, "tree": tree, "votes": out.tobytes(), "mixed": shares.tobytes()}


def _walk(rec: np.ndarray, tree: int, seed: int, splits: dict[Node, tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(key, level, rows) below the splits known so far."""
    todo = [(_root(seed, tree), 0, np.arange(len(rec)))]
    while todo:
        key, level, rows = todo.pop()
        if (split := splits.get((tree, int(key[0])))) is None:
            yield int(key[0]), level, rows
            continue
        right = rec["bins"][rows, split[0]] > split[1]
        for child, part in zip(_children(key), (rows[~right], rows[right]), strict=True):
            if len(part):
                todo.append((child[None], level + 1, part))


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _key(signed: int) -> np.ndarray:
    return np.array([signed & ((1 << 64) - 1)], np.uint64)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _between(x: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints of neighbouring values: all of them, or those nearest to the quantiles; ``x`` ascends and occurs ``n`` times."""
    lower, upper = x[:-1], x[1:]
    middle = np.where(np.isinf(lower) | np.isinf(upper), lower, lower / 2 + upper / 2)
    if len(x) <= bins:
        return middle
    upto = np.cumsum(n)[:-1]
    wanted = np.arange(1, bins) * (n.sum() / bins)
    after = np.clip(np.searchsorted(upto, wanted), 1, len(upto) - 1)
    return np.unique(middle[np.where(wanted - upto[after - 1] <= upto[after] - wanted, after - 1, after)])


def thresholds(train: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Ascending values that cut each feature into ``bins`` parts at most: between all its values if they are few, else at quantiles.

    Quantiles of up to ``bins`` times ``bins`` different values lie between two values, those of more are values.
    """
    lone = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(features)]))
    values = train.select(lone.alias("_v")).select("_v.f", "_v.x").where("x is not null and not isnan(x)")
    values = written(values.groupBy("f", "x").agg(F.count("*").alias("n")), "feature-values")
    sizes = values.groupBy("f").agg((F.count("*") <= bins * bins).alias("few"))
    of = {r.f: r.few for r in sizes.collect()}
    many = [f for f in sorted(of) if not of[f]]
    few = values.where(~F.col("f").isin(many)).orderBy("f", "x").collect() if len(many) < len(of) else []
    cuts = {}
    for f in of.keys() - set(many):
        own = [r for r in few if r.f == f]
        cuts[f] = _between(np.array([r.x for r in own]), np.array([r.n for r in own]), bins)
    if many:
        typed = train.select(*[F.col(f"`{features[i]}`").cast("double").alias(f"_{i}") for i in many])
        quantiles = typed.approxQuantile([f"_{i}" for i in many], [k / bins for k in range(1, bins)], 0.1 / bins)
        cuts |= {i: np.unique(q) for i, q in zip(many, quantiles, strict=True)}
    return [cuts.get(i, np.empty(0)) for i in range(len(features))]


def _packed(rows: DataFrame, features: list[str], cuts: list[np.ndarray], kind: np.dtype) -> DataFrame:
    """(block, rows): the rows (_row, _hash, _cls, features) with bins for values, many in one; a missing value is in the last bin."""
    schema = pa.schema([("block", pa.int64()), ("rows", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column("_row").to_numpy(zero_copy_only=False)
            rec = np.empty(len(number), kind)
            rec["row"], rec["hash"], rec["cls"] = number % BLOCK, b.column("_hash").to_numpy(zero_copy_only=False).view(np.uint64), b.column("_cls").to_numpy(zero_copy_only=False)
            for i, c in enumerate(cuts):
                rec["bins"][:, i] = np.searchsorted(c, b.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(np.float64), "left")
            order = np.argsort(number // BLOCK, kind="stable")
            of, first = np.unique(number[order] // BLOCK, return_index=True)
            yield _batch([{"block": int(k), "rows": rec[p].tobytes()} for k, p in zip(of, np.split(order, first[1:]), strict=True)], schema)

    values = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(math.nan)).alias(f"_x{i}") for i, c in enumerate(features)]
    return rows.select("_row", "_hash", "_cls", *values).mapInArrow(pack, "block long, rows binary")


def _split_large(packed: DataFrame, trees: int, seed: int, depth: int, n_bins: int, weights: np.ndarray, kind: np.dtype, local: int) -> tuple[dict[Node, tuple[int, int]], dict[Node, list[int]]]:
    """Splits of the nodes that more than ``local`` rows reach, and class counts of those that can't be split; a few for each ``local`` rows and tree."""
    n_features, classes = kind["bins"].shape[0], len(weights)
    slots = math.ceil(math.sqrt(n_features))
    shape = (slots, n_bins, classes)
    splits: dict[Node, tuple[int, int]] = {}
    leaves: dict[Node, list[int]] = {}
    level = 0
    wanted = {(t, int(_root(seed, t)[0])) for t in range(trees)}
    schema = pa.schema([("tree", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("counts", pa.binary())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Node, np.ndarray] = {}
        reached: dict[Node, int] = {}
        for b in batches:
            for blob in b.column("rows").to_pylist():
                rec = np.frombuffer(blob, kind)
                for t in range(trees):
                    n = None
                    for key, _, rows in _walk(rec, t, seed, splits):
                        if (t, key) not in wanted:
                            continue
                        n = _drawn(rec, seed, t) if n is None else n
                        reached[t, key] = reached.get((t, key), 0) + len(rows)
                        rows = rows[n[rows] > 0]
                        asked = _asked(np.array([key], np.uint64), n_features)[0]
                        at = (np.arange(slots) * n_bins + rec["bins"][rows][:, asked]) * classes + rec["cls"][rows][:, None]
                        sums = np.bincount(at.ravel(), np.repeat(n[rows], slots), math.prod(shape)).astype(np.int64)
                        held[t, key] = held[t, key] + sums if (t, key) in held else sums
        for (t, key), sums in held.items():
            yield _batch([{"tree": t, "key": _signed(key), "n": reached[t, key], "counts": sums.tobytes()}], schema)

    def chosen(key: tuple, table: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist()], axis=0).reshape(shape)
        total = sums[0].sum(0)
        feature, cut = -1, 0
        if level < depth and (total > 0).sum() > 1:
            slot, at, cls = np.nonzero(sums)
            found, cuts = _choose(np.zeros_like(slot), slot, at, cls, sums[slot, at, cls], 1, slots, n_bins, weights)
            if found[0] >= 0:
                feature, cut = int(_asked(_key(key[1].as_py()), n_features)[0, found[0]]), int(cuts[0])
        n = sum(table.column("n").to_pylist())
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "key": pa.array([key[1].as_py()], pa.int64()), "n": [n], "feature": pa.array([feature], pa.int32()), "cut": pa.array([cut], pa.int32()), "total": [total.tolist()]})

    while wanted:
        partial = packed.select("rows").mapInArrow(counted, "tree int, key long, n long, counts binary")
        found = partial.groupBy("tree", "key").applyInArrow(chosen, "tree int, key long, n long, feature int, cut int, total array<long>").collect()
        below: set[Node] = set()
        for r in found:
            node = (r.tree, int(_key(r.key)[0]))
            if r.n <= local:
                continue
            if r.feature < 0:
                leaves[node] = list(r.total)
            else:
                splits[node] = (r.feature, r.cut)
                below |= {(r.tree, int(k)) for k in _children(_key(r.key))}
        wanted, level = below, level + 1
    return splits, leaves


def votes(rows: DataFrame, features: list[str], cls: Column, key: Column, weights: list[float], trees: int, seed: int, depth: int, bins: int, local: int = LOCAL) -> DataFrame:
    """(_row, best, share): of each of ``rows`` the class that a forest gives the largest mean share, and that share.

    ``rows`` have ``_row``, numbers in runs without large gaps; ``cls`` is a row's class from 0 where the forest learns from it, else -1; ``key`` is what draws are by.
    Trees split at ``bins`` quantiles of a feature, each node by the best of a few features, until leaves are pure, ``depth`` levels at most.
    """
    w, n_bins = np.array(weights, np.float64), bins
    typed = rows.withColumns({"_cls": cls.cast("int"), "_hash": F.xxhash64(key)})
    cuts = thresholds(typed.where("_cls >= 0"), features, bins)
    kind = np.dtype([("row", "<u2"), ("cls", "<i4"), ("hash", "<u8"), ("bins", "u1" if bins <= 256 else "<u2", (len(features),))])
    sent = np.dtype([("row", "<u2"), ("cls", "<i4"), ("n", "u1"), ("bins", kind["bins"].base, (len(features),))])
    packed = written(_packed(typed, features, cuts, kind), "forest-rows")
    many = rows.count()
    splits, leaves = _split_large(packed, trees, seed, depth, n_bins, w, kind, local) if many > local else ({}, {})
    dealt_schema = pa.schema([("tree", pa.int32()), ("key", pa.int64()), ("level", pa.int32()), ("block", pa.int64()), ("rows", pa.binary())])
    votes_schema = pa.schema([("block", pa.int64()), ("tree", pa.int32()), ("votes", pa.binary()), ("mixed", pa.binary())])
    votes_ddl = "block long, tree int, votes binary, mixed binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column("block").to_pylist(), b.column("rows").to_pylist(), strict=True):
                rec = np.frombuffer(blob, kind)
                own = np.empty(len(rec), sent)
                own["row"], own["cls"], own["bins"] = rec["row"], rec["cls"], rec["bins"]
                out = []
                for t in range(trees):
                    own["n"] = _drawn(rec, seed, t)
                    out += [{"tree": t, "key": _signed(k), "level": level, "block": block, "rows": own[r].tobytes()} for k, level, r in _walk(rec, t, seed, splits) if (t, k) not in leaves]
                yield _batch(out, dealt_schema)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column("block").to_pylist(), b.column("rows").to_pylist(), strict=True):
                rec = np.frombuffer(blob, kind)
                met = [(t, leaves[t, k], r) for t in range(trees) for k, _, r in _walk(rec, t, seed, splits) if (t, k) in leaves]
                yield _batch([_votes(block, t, rec["row"][r], np.zeros(len(r), np.int64), np.array([c]), w) for t, c, r in met], votes_schema)

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        tree, node, level = (k.as_py() for k in key)
        blocks = table.column("block").to_pylist()
        parts = [np.frombuffer(r, sent) for r in table.column("rows").to_pylist()]
        rec = np.concatenate(parts)
        leaf, counts = _grow(rec["bins"], rec["cls"].astype(np.int64), rec["n"], _key(node), level, depth, n_bins, w)
        each = np.split(leaf, np.cumsum([len(p) for p in parts])[:-1])
        return pa.Table.from_pylist([_votes(k, tree, p["row"], x, counts, w) for k, p, x in zip(blocks, parts, each, strict=True)], votes_schema)

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        shares, met = np.zeros((BLOCK, len(w))), np.zeros(BLOCK, bool)
        for r in table.sort_by("tree").to_pylist():  # in order, so that sums agree between runs
            v = np.frombuffer(r["votes"], _VOTES)
            shares[v["row"]] += np.vstack([np.eye(len(w)), np.frombuffer(r["mixed"]).reshape(-1, len(w))])[v["leaf"]]
            met[v["row"]] = True
        at = np.flatnonzero(met)
        shares = shares[at]
        none = shares.sum(1) == 0
        mean = shares / np.where(none, 1, shares.sum(1))[:, None]
        return pa.table({"_row": key[0].as_py() * BLOCK + at, "best": pa.array(mean.argmax(1).astype(np.int32), mask=none), "share": pa.array(mean.max(1), mask=none)})

    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-many * trees // (4 * LOCAL)))
    nodes = packed.mapInArrow(deal, "tree int, key long, level int, block long, rows binary").repartition(tasks, "tree", "key", "level")
    cast = nodes.groupBy("tree", "key", "level").applyInArrow(finish, votes_ddl)
    if leaves:
        cast = cast.unionByName(packed.mapInArrow(settle, votes_ddl))
    return cast.groupBy("block").applyInArrow(add_up, "_row long, best int, share double")
