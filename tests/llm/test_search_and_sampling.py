"""Importance resampling, lexical search and SimHash against plain runs, with odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

pytest.importorskip("public_tokenizers")

from scanforge import tables  # noqa: E402
from scanforge.llm import chat, importance, search, simhash, url_filter  # noqa: E402

LONG = "alpha Beta gamma-delta epsilon 42 zeta eta theta iota kappa " * 400
TEXTS = [None, "", " \n.,", "One two", "one TWO", LONG, LONG, "Ünï çode 漢字 x1 y2", LONG + "tail", "a b c d e f g h i j k l m n o p q r s t u", "rare words only here"]
ROWS = [(i, t, "s", 7, 1.5) for i, t in enumerate(TEXTS)] + [(5, LONG, "s", 8, 2.5), (5, "another text under a repeated id, long enough " * 4, "s", 8, 2.5), (None, "no id has this text of quite a few words " * 3, "s", 9, 0.5)]
ITEMS = [(1, "one two alpha alpha"), (2, None), (3, "漢字 zzz"), (3, "漢字 zzz"), (4, "none-of-these"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa words only x1 42")]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, term string, rank int, score double")  # names that operators use


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1)


def plain_resample(rows, target, percent, max_n=1, n_buckets=10_000):
    def buckets(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % n_buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)], len(w)

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets(text)[0])
    for text in target:
        t.update(buckets(text)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + n_buckets) / ((s[b] + 1) * (t.total() + n_buckets)))) for b in range(n_buckets)]
    out = []
    for i, text in rows:
        found, words = buckets(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words >= 20, None])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[5] = place + 1
    return sorted(((r[0], r[1], r[2], r[3], r[5]) for r in out), key=str)


@pytest.mark.parametrize("percent, max_n, n_buckets", [(10, 1, 10_000), (50, 1, 10_000), (100, 3, 64), (0, 2, 10_000)])
def test_importance(docs, items, percent, max_n, n_buckets):
    got = importance.resample(docs, items, percent, max_n, n_buckets).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == plain_resample([(i, t) for i, t, *_ in ROWS], [t for _, t in ITEMS], percent, max_n, n_buckets)


def test_importance_draws_across_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(tables, "RANGE_ROWS", 20)
    rng = random.Random(3)
    rows = [(rng.choice([k, 7]), " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(15, 30)))) for k in range(500)]  # a third of all rows have one id
    target = ["a b aa"]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, t) for t in target], "item_id long, text string"), 30)
    assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == plain_resample(rows, target, 30)


def test_importance_of_nothing(docs, items):
    assert importance.op11(docs.limit(0), items).count() == 0
    assert sorted(map(tuple, importance.op11(docs, items.limit(0)).collect()), key=str) == plain_resample([(i, t) for i, t, *_ in ROWS], [], 10)


def plain_search(rows, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    held = [(i, Counter(w), len(w)) for i, w in ((i, terms(t)) for i, t in rows) if w]
    n, total, df = len(held), sum(k for *_, k in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, counts, k in held:
            m = 100 - 25 + 25 * k * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 12 * m)) for t in terms(text) if counts[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("top, block_bytes", [(20, 8 << 20), (2, 1), (1, 150)])
def test_search(docs, items, top, block_bytes):
    got = search.search(docs, items, top, block_bytes=block_bytes).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == plain_search([(i, t) for i, t, *_ in ROWS], ITEMS, top)


def test_search_of_many(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{min(int(rng.expovariate(0.05)), 300)}"
    rows = [(i % 900, " ".join(word() for _ in range(int(rng.lognormvariate(3, 1))))) for i in range(1000)]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(30)]
    monkeypatch.setattr(search, "CELLS", 5000)  # blocks of a few documents
    got = search.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == plain_search(rows, items, 5)


def test_search_of_nothing(docs, items):
    assert search.op12(docs.limit(0), items).count() == 0
    assert search.op12(docs, items.limit(0)).count() == 0
    assert search.op12(docs, items).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_impact_bytes_bound():
    tf, m = np.meshgrid(np.array([1, 2, 3, 10, 500, 10**6]), np.array([75, 76, 100, 900, 10**5, 10**9]))
    exact = search.impacts(tf.ravel(), m.ravel())
    level = search.impact_bytes(exact).astype(np.int64)
    assert (exact * 255 <= level * 10**6).all() and ((level - 1) * 10**6 < exact * 255).all() and exact.max() < 10**6


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    """Least id of each row's component, by comparing all pairs."""
    array, least = np.array(prints, np.uint64), list(range(len(prints)))
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 2):
            a, b = least[i], least[int(j)]
            if a != b:
                least = [b if x == a else x for x in least]
    return [min((ids[j] for j in range(len(ids)) if least[j] == least[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def test_fingerprints(docs):
    for _, text, *_ in ROWS:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    prints = [plain_fingerprint(t) for _, t, *_ in ROWS]
    want = zip([i for i, *_ in ROWS], [f"{p:016x}" for p in prints], plain_components(prints, [i for i, *_ in ROWS]), strict=True)
    assert sorted(map(tuple, simhash.op13(docs).collect()), key=str) == sorted(want, key=str)
    assert simhash.op13(docs.limit(0)).count() == 0


def test_perfect_codes():
    for length, generator, radius in simhash.CODES:
        code = simhash.code_of(length, generator, radius, 2)
        assert (code.upto[:, 0] == 1).all()  # one code word within the radius of every word: a perfect code
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**64, 300, dtype=np.uint64)
    moved = prints.copy()
    for _ in range(2):
        moved ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    homes, away = (simhash.anchors(x) for x in (prints, moved))
    for k in range(300):
        (home,) = homes[1][(homes[0] == k) & homes[2]]
        assert home in away[1][away[0] == k]
    assert len(np.unique(simhash._cells(homes[1]))) == len(np.unique(homes[1])) and simhash.CELL_BITS == 26


@pytest.mark.parametrize("homes", [2000, 5])
def test_links_connect_chains_and_crowds(spark, monkeypatch, homes):
    monkeypatch.setattr(simhash, "HOMES", homes)  # 5: crowded anchors are dealt over many groups
    monkeypatch.setattr(simhash, "CAME", 16)
    rng = random.Random(homes)
    prints = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(4):
        p = rng.getrandbits(64)
        for _ in range(60):  # a chain: far apart at its ends, two bits a step
            p ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.append(p)
        prints += [p ^ (1 << i) ^ (1 << j) for i in range(0, 64, 5) for j in range(i)]  # a crowd around one
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    rows = spark.createDataFrame([(p,) for p in prints], "print long").repartition(5)
    found = simhash.links(rows).collect()
    assert len(found) < 200 * len(prints)
    unsigned = [p % (1 << 64) for p in prints]
    assert all((r["a"] % (1 << 64)) in unsigned and (r["b"] % (1 << 64)) in unsigned for r in found)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(rows)).collect()}
    want = plain_components(unsigned, prints)
    assert [got.get(p, p) for p in prints] == want


def test_very_long_urls(spark):
    deep, far = "a." * 20_000 + "NET", "/es/" + "x/" * 100_000
    rows = [(1, f"https://{deep}{far}?q#f"), (2, f"http://net/{'y' * 200_000}"), (3, far), (4, f"x://www.example.com/en/{'z' * 100_000}"), (5, f"x://{'w' * 100_000}.example.com/en/"), (6, "://" + "?" * 100_000)]
    got = {r.page_id: (len(r.host), len(r.path), r.rule, r.verdict) for r in url_filter.op5(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {
        1: (len(deep), len(far), "net/es/", "block"), 2: (3, 200_001, None, "allow"), 3: (0, 0, None, "allow"),
        4: (15, 100_004, "www.example.com/en/", "allow"), 5: (100_012, 4, "example.com/en/", "block"), 6: (0, 0, None, "allow"),
    }


def test_long_texts_and_clashing_names_in_conversations(spark):
    long = "word <|im_end|> é\n" * 120_000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (2, 0, "user", long), (2, 1, "assistant", None)]
    plain = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    clashing = plain.selectExpr("*", "9 AS tree", "8 AS id", "7 AS key", "6 AS place", "'x' AS parent", "1.5D AS score", "0 AS depth", "map('a', 1) AS total")
    got = {r.conv_id: r for r in chat.op8(clashing).collect()}
    assert set(got) == {-1, 1, 2}
    for conv in (1, 2):
        turns = "".join(f"{r}\n{t or ''}\n" for c, _, r, t in rows if c == conv)
        answers = "".join(t or "" for c, _, r, t in rows if c == conv and r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (2, hashlib.sha256(turns.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(answers), hashlib.sha256(answers.encode()).hexdigest())
    assert sorted(map(str, chat.op8(plain).collect())) == sorted(map(str, got.values()))
