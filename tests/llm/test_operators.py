"""Small cases with defined results, against brute force."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from scanforge.llm import ann, byte_bpe, chat, jaccard, lm_score, mixing, quality, sharding, token_files, url_filter  # noqa: E402
from scanforge.llm.pieces import PieceEncoder, cut  # noqa: E402

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 40
TEXTS = [None, "", "   \n", "One two", "One two", LONG, LONG, "  lead  and  trail \n", "don't stop\n\nNow: x-y 2.5%", "\xa0é ß\u200b漢 😀<|endoftext|>", LONG + "tail", "a\nb\na\nb\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "s0", "s1", "s1"][i % 4], 0, "x") for i, t in enumerate(TEXTS)]
    rows += [(5, LONG, "en", "s1", 0, "y"), (None, "null id here is a text", "en", "s0", 0, "z")]  # a repeated id, a null id
    # further columns with names that operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, key string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)  # as it is: the special string in a text is its token
    out = token_files.op1(docs, JSON).collect()
    by_start = sorted(out, key=lambda r: r.start)
    ids = [r.doc_id for r in by_start]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(out) == docs.count()
    at = 0
    for r in by_start:
        assert r.start == at
        at += r.n_tokens
    for r in out:
        text = "null id here is a text" if r.doc_id is None else TEXTS[r.doc_id]
        want = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.n_tokens, r.ids_crc32) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
    assert token_files.op1(empty, JSON).count() == 0


def test_sequences_are_views_with_masks(tmp_path):
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as sink:
        writer = token_files.SequenceWriter(sink, pa.uint16(), 8, 2)
        for part in (np.arange(5, dtype=np.uint32), np.arange(5, 37, dtype=np.uint32)):
            writer.append(part)
        writer.close()
    f = token_files.TokenFile(f"file://{tmp_path}/a.arrow")
    assert len(f) == 5 and f.sequence(3).tolist() == list(range(24, 32)) and not f.sequence(3).flags.owndata
    assert f.mask(4).tolist() == [True] * 5 + [False] * 3 and f.span(14, 5).tolist() == [14, 15, 16, 17, 18]


def test_shards(docs, empty):
    out = sharding.op2(docs, 3).collect()
    total = sum(r.size for r in out)
    for k in {r.shard for r in out}:
        mine = [r for r in out if r.shard == k]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 3) <= max(r.size for r in out)
    order = [r.shard for r in sorted(out, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.shard))]
    assert order == sorted(order)
    assert {r.text_crc32 for r in out if r.doc_id == 4} == {zlib.crc32(b"One two")} and all(r.grown_shard is None for r in out)
    assert sharding.op2(empty).count() == 0


@pytest.mark.parametrize("n_shards", [1, 4, 16])
def test_shards_equal_a_plain_run(spark, monkeypatch, n_shards):
    from scanforge import tables

    monkeypatch.setattr(tables, "RANGE_ROWS", 40)  # several ranges
    rng = np.random.default_rng(2)
    rows = [(int(i), "é" * int(n)) for i, n in zip(rng.integers(0, 150, 300), rng.zipf(1.4, 300) % 5000, strict=True)] + [(None, None), (None, "z"), (3, "x" * 200_000), (3, "x" * 200_000)]
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1)
    at, want, slots = 0, [], Counter()
    total = sum(key(r)[3] for r in rows)
    for r in sorted(rows, key=key):
        size = key(r)[3]
        shard = min(n_shards - 1, (2 * at + size) * n_shards // (2 * total))
        want.append((r[0], size, key(r)[2], shard, slots[shard]))
        slots[shard] += 1
        at += size
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.op2(df.repartition(3), n_shards).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def base(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_ledger(docs, empty):
    got = quality.op3(docs).collect()
    for r in got:
        text = "null id here is a text" if r.doc_id is None else TEXTS[r.doc_id]
        want = base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    led = quality.ledger(docs)
    assert led.columns.count("n_words") == 1 and "key" in led.columns
    every = Counter(r.failed_rules for r in led.collect())
    for policy, r in ((p, r) for p in quality.POLICIES for r in quality.ablations(led, p).collect()):
        masks, bit = Counter(), 1 << quality.RULES.index(r.rule)
        for m, n in every.items():
            masks[m & quality.mask_of(policy)] += n  # the rules that the policy has
        assert r.failing == sum(n for m, n in masks.items() if m & bit) and r.failing_alone == masks.get(bit, 0)
        assert r.kept_without == sum(n for m, n in masks.items() if not m & ~bit)
    assert quality.op3(empty).count() == 0


def test_mix(spark, docs, empty):
    out = mixing.op4(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in out)
    again = mixing.op4(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id or -1, r["size"], r.taken, r.target)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.op4(empty).count() == 0
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), f"s{i % 5}") for i in range(2000)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.op4(many).collect():
        taken[f"s{r.doc_id % 5}"] += r.taken
        target[f"s{r.doc_id % 5}"] = r.target
    assert all(abs(taken[s] - t) <= 50 for s, t in target.items())
    assert math.isclose(sum(target.values()), 1.5 * sum(len(t.split()) for _, t, _ in rows))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.select(F.sum(mixing.n_words_of(F.col("text")))).first()[0] == sum(r.taken for r in out)


def spark_hash(*parts):
    """The engine's xxhash64 of longs, ints (as bool), strings and nulls."""
    h = 42
    for x in parts:
        if x is not None:
            data = struct.pack("<i", x) if isinstance(x, bool) else x.encode() if isinstance(x, str) else struct.pack("<q", x)
            h = xxhash.xxh64_intdigest(data, seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def plain_targets(sizes):
    """The contract's loop, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    stopped = set()
    while True:
        free = [s for s in names if s not in stopped]
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in stopped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return share | {s: 2.0 * sizes[s] for s in stopped}
        stopped |= over


def plain_mix(rows, block=mixing.BLOCK):
    """(doc_id, source, text): copies of all equal rows, by the same draws in one process."""
    counted, sizes = Counter(rows), Counter()
    for (_, s, t), m in counted.items():
        sizes[s] += m * len(words(t))
    targets, copies, level = plain_targets(sizes), {}, {}
    for row, m in counted.items():
        i, s, t = row
        size = len(words(t))
        wanted = m * targets[s] / sizes[s] if sizes[s] and size else 0.0
        copies[row] = math.floor(wanted + 1e-9)
        h = 42 if t is None else spark_hash(t)
        key = spark_hash(i is None, i, s is None, s, False, size, False, h)
        if size:
            level.setdefault(s, []).append((size, max(0.0, (wanted - copies[row]) * size), key, row))
    depth = 0
    draw = lambda a, b, d: (xxhash.xxh64_intdigest(struct.pack("<i", 0), seed=xxhash.xxh64_intdigest(struct.pack("<i", d), seed=spark_hash(a, b) % (1 << 64)))) % (1 << 52) / (1 << 52)
    while level:
        still = {}
        for s, items in level.items():
            for size, mass, _, row in items:
                if not 1e-6 < mass < size - 1e-6:
                    copies[row] += mass > size / 2
            if open_ := [x for x in items if 1e-6 < x[1] < x[0] - 1e-6]:
                still[s] = open_
        most = max(map(len, still.values()), default=0)
        if most <= 1:
            for (size, mass, _, row), in still.values():
                copies[row] += mass * 2 > size
            return copies, targets, sizes
        blocks, level = math.ceil(most / block), {}
        for s, items in still.items():
            by = {}
            for x in items:
                h = xxhash.xxh64_intdigest(struct.pack("<i", 0), seed=xxhash.xxh64_intdigest(struct.pack("<i", depth), seed=spark_hash(x[2]) % (1 << 64)))
                by.setdefault((h - (1 << 64) if h >= 1 << 63 else h) % blocks, []).append(x)
            for group in by.values():
                group.sort(key=lambda x: x[:3], reverse=True)
                a = group[0]
                for b in group[1:]:
                    down, up = min(a[1], b[0] - b[1]), min(b[1], a[0] - a[1])
                    if draw(a[2], b[2], depth) * (down + up) < up:
                        if a[1] <= b[0] - b[1]:
                            a = (b[0], a[1] + b[1], *b[2:])
                        else:
                            copies[b[3]] += 1
                            a = (a[0], a[1] - (b[0] - b[1]), *a[2:])
                    elif b[1] <= a[0] - a[1]:
                        a = (a[0], a[1] + b[1], *a[2:])
                    else:
                        copies[a[3]] += 1
                        a = (b[0], b[1] - (a[0] - a[1]), *b[2:])
                level.setdefault(s, []).append(a)
        depth += 1
    return copies, targets, sizes


def test_mix_equals_a_plain_run(spark):
    rng = np.random.default_rng(5)
    same = [(i, s, " ".join(["w"] * (1 + i * 13 % 40))) for i in range(300) for s in ("a", "b", "c")]  # the same documents in three sources
    rows = same + [(int(i), None if i % 2 else "", "x " * int(rng.integers(0, 30))) for i in range(400)] + [(7, "a", "again and again")] * 45 + [(None, "d", None), (1, "d", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    copies, targets, sizes = plain_mix(rows)
    got = mixing.op4(df.withColumn("_m", F.lit(1)).repartition(3)).collect()
    taken, size = Counter(), Counter()
    for r in mixing.mix(df).collect():
        taken[r.doc_id, r.source, r.text] += 1
    assert taken == Counter({k: n for k, n in copies.items() if n})
    want = sorted((i or -1, len(words(t)), sizes[s], round(targets[s], 6)) for i, s, t in rows)
    assert sorted((r.doc_id or -1, r["size"], r.source_size, round(r.target, 6)) for r in got) == want
    assert all(r.taken <= 2 * r["size"] for r in got) and sum(r.taken for r in got) == sum(n * len(words(t)) for (_, _, t), n in copies.items())
    for (_, s, t), n in copies.items():
        size[s] += n * len(words(t))
    assert all(abs(size[s] - t) <= 20 for s, t in targets.items())  # half of the largest document
    again = [r.taken for r in got if r.doc_id == 7 and r["size"] == 3]
    assert len(again) == 45 and max(again) - min(again) <= 3


def test_mix_keeps_clashing_columns(spark):
    rows = [(1, "s", "one two three", 5, 6), (1, "s", "one two three", 7, 8), (2, "s", "four", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, m long, `_tie` long")
    out = mixing.mix(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= set(rows)
    assert mixing.mix(df.limit(0)).count() == 0


def test_source_targets_share_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20 and got["b"] == pytest.approx(1996.6667, abs=1e-3) and got["c"] == pytest.approx(998.3333, abs=1e-3) and got[None] == 0


def test_url_rules(spark):
    urls = [None, "no scheme", "http://Example.com/en/x", "http://www.EXAMPLE.com/en/x?y", "http://a.www.example.com/en/", "http://notexample.com/en/", "http://x.net/es/1#t", "http://x.net/de/", "http://net/fr/", "http://com", "x://a.com?/es/", "http://a.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.op5(pages).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("example.com", "/en/x", "example.com/en/", "block") and got[3][2:] == ("www.example.com/en/", "allow") and got[4][2] == "www.example.com/en/"
    assert got[5][2:] == ("com/", "allow") and got[6][1:] == ("/es/1", "net/es/", "block") and got[7][2] is None and got[8][3] == "block"
    assert got[9][2] is None and got[10] == ("a.com", "", None, "allow") and got[11][2] == "com/"
    assert url_filter.op5(pages.limit(0)).count() == 0


def test_url_rules_keep_rows_and_columns(spark):
    rows = [(1, "http://a.com/", "h", 1), (1, "http://a.com/", "h", 1), (2, None, None, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, _host string, found long")
    out = url_filter.filter_urls(pages)
    assert out.columns == [*pages.columns, "judged"] and sorted(tuple(r)[:4] for r in out.collect()) == rows


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b))
    url_filter.DigestArray.save([("ab", "/", "block"), ("cd", "/", "allow")], str(tmp_path / "r"))
    index = url_filter.DigestArray.load(str(tmp_path / "r"))
    found = index.find(["ab/", "cd/", "xy/"])
    assert found[2] == -1 and len({found[0], found[1], -1}) == 3


@pytest.fixture(scope="module")
def tik():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, empty, tik):
    for r in byte_bpe.op6(docs, RANKS, public_tokenizers.PATTERN).collect():
        text = ("null id here is a text" if r.doc_id is None else TEXTS[r.doc_id]) or ""
        ids = tik.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.op6(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_prefix_tables_append_and_edit(tik):
    bpe, rng = byte_bpe.PrefixBPE.load(RANKS), np.random.default_rng(0)
    for _ in range(200):
        data = bytes(rng.choice(list(b"abcdeth nionr\xc3\xa9"), rng.integers(1, 60)))
        cut_at = int(rng.integers(0, len(data)))
        table = bpe.extend(data, bpe.extend(data[:cut_at], []))  # appending
        assert bpe.walk(table) == tik._encode_single_piece(data) and bpe.decode(bpe.walk(table)) == data
        edited, after = bpe.edit_piece(data, table, cut_at, min(len(data), cut_at + 3), b"xy")
        assert after == bpe.extend(edited, [])


def test_cut_joins_to_the_text():
    pieces, codes, offsets = cut(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        assert "".join(pieces[c] for c in codes[offsets[i] : offsets[i + 1]]) == (t or "")


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)  # several rounds of queries, one chunk at a time
    monkeypatch.setattr(ann, "QUERY_BYTES", 1)
    monkeypatch.setattr(ann, "GROUP", 1)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(900, 16)).astype(np.float32)
    v[300:340] = v[300]  # many equal vectors
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [float("inf")] + [0.0] * 15), (1400, [1.0] * 3), (1500, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    out = {}
    for r in ann.op7(df).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(out) == set(range(0, 900, 100))
    hit = 0
    for q, found in out.items():
        d = np.sqrt(((v.astype(np.float64) - v[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(math.isclose(f[2], d[f[1]], rel_tol=1e-12) or f[2] == d[f[1]] for f in found)
        hit += len(set(best) & {f[1] for f in found})
    assert hit >= 0.9 * 90 and [f[1] for f in out[300]][:10] == list(range(301, 311))
    assert ann.op7(df.limit(0)).count() == 0 and ann.op7(df.where("vec_id in (100, 200, 201)")).count() == 4


def test_nearest_in_double_precision_and_with_repeated_ids(spark):
    far = [(i, [1e8 + 0.25 * i, -1e8]) for i in range(300)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.op7(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()}
    assert got[100, 1] == (99, 0.25) and got[100, 2] == (101, 0.25) and got[0, 1] == (1, 0.25) and len(got) == 30
    same = spark.createDataFrame([(0, [0.0, 1.0]), (0, [0.0, 3.0]), (1, [0.0, 6.0]), (2, [1e300, 1.0])], "vec_id long, embedding array<double>").withColumn("row", F.lit(1))
    rows = sorted((r["rank"], r.vec_id, r.score) for r in ann.op7(same.where("vec_id < 2")).collect())
    assert rows == [(1, 0, 2.0), (1, 0, 2.0), (2, 1, 3.0), (2, 1, 5.0)]
    assert ann.op7(same).count() == 6
    hot = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(500)] + [(500 + i, [1.0, 3.0 + i]) for i in range(20)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.op7(hot.repartition(3)).collect()}
    assert [got[0, k] for k in range(1, 11)] == list(range(1, 11)) and [got[400, k] for k in range(1, 11)] == list(range(10))


def test_chat(spark):
    texts = ["<|im_end|>\n<|im_start|>", "<\\|im_end|>", "%0A <\\\\| %25", "", None, "plain"]
    rows = [(c, t, "assistant" if t % 2 else "us\ner%", texts[(c or 0) + t - 1 if (c or 0) + t < 7 else 0]) for c in (1, 2, None) for t in range(1, 4)] + [(1, 3, "assistant", "tie")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.op8(df).collect()}
    assert set(got) == {1, 2, None, -1} and got[-1].n_turns == 2
    for conv in (1, 2, None):
        turns = sorted((t, r, x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.op8(df.limit(0)).count() == 1


def test_a_long_conversation_is_numbered_over_ranges(spark, monkeypatch):
    from scanforge import tables

    monkeypatch.setattr(tables, "RANGE_ROWS", 300)
    rows = [(7, (i * 7919) % 3000, "assistant" if i % 2 else "user", f"text {i % 11} " + "x" * (i % 90)) for i in range(3000)] + [(i, 1, "user", "hi") for i in range(200)]
    got = {r.conv_id: r for r in chat.op8(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    turns = sorted((t, r, x) for c, t, r, x in rows if c == 7)
    assert len(got) == 201 and got[7].n_turns == len(turns) == 3001
    assert got[7].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "a", 0.0), ("t", 2, 1, "assistant", "b", 1.0), ("t", 3, 1, "assistant", "c", 5.0), ("t", 4, 2, "user", "d", 9.0), ("t", 5, 99, "user", "orphan", 0.0), ("t", 6, 7, "user", "loop", 0.0), ("t", 7, 6, "user", "loop", 0.0)]
    rows += [("long", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    every = chat.best_paths(df, None).where("tree = 't'").collect()
    paths = {}
    for r in every:
        paths.setdefault(r["rank"], []).append((r.pos, r.id))
    assert {k: [i for _, i in sorted(p)] for k, p in paths.items()} == {1: [1, 2, 4], 2: [1, 3], 3: [5]}
    formatted = {r.tree: r.formatted for r in chat.format_conversations(df).collect()}
    assert formatted["t"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nd<|im_end|>\n"
    assert [t.split("\n")[1].split("<")[0] for t in formatted["long"].split("<|im_start|>")[1:]] == [str(i) for i in range(40)]


def lower_words(text):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words(text)]


def test_scores(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    toks = [[*lower_words(t), None] for _, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (i, _), t, h in zip(rows, toks, held, strict=True))
    out = lm_score.op9(docs).collect()
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(math.isfinite(r.score) for r in out) and lm_score.op9(empty).count() == 0


def test_automaton_is_a_distribution(spark, monkeypatch):
    rng = np.random.default_rng(0)
    vocabulary = list("abcdef")
    rows = [(i, " ".join(rng.choice(vocabulary, 40, p=[0.3, 0.3, 0.1, 0.1, 0.1, 0.1]))) for i in range(60)]
    chunks, answers, n_tokens, distinct, unknown = lm_score.answered(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    (row,) = chunks.toArrow().to_pylist()
    own = lm_score._Chunk(row, answers.toArrow(), lm_score.ORDER)
    model, n = own.automaton(unknown, n_tokens), len(own.levels[0].keys)
    assert n == distinct == len(vocabulary) + 1 and len(model.fail) > n + 1  # longer states than single words
    place = {w: int(np.flatnonzero(own.levels[0].keys == np.uint64(xxhash.xxh64_intdigest(w.encode())))[0]) for w in vocabulary}
    for context in ("", "a", "ab", "bba", "fedcb"):
        texts = [[place[c] for c in context] + [w] for w in range(n)]
        logs = model.walk(np.concatenate(texts), np.arange(n + 1) * (len(context) + 1))
        assert 1 - unknown - 1e-9 < (10 ** logs.reshape(n, -1)[:, -1]).sum() < 1 + 1e-9  # the rest is for unknown words
    long = rng.integers(0, n, 2000)
    whole = model.walk(long, np.array([0, 700, 2000]))
    monkeypatch.setattr(lm_score, "SEGMENT", 3)
    assert np.array_equal(whole, model.walk(long, np.array([0, 700, 2000])))  # segments change nothing


def brute_scores(rows, held):
    """The interpolated trigram model of all n-grams seen twice, in plain Python."""
    toks = {i: [*lower_words(t), None] for i, t in rows}
    grams = [Counter(tuple(t[k : k + m]) for i, t in toks.items() if not held(i) for k in range(len(t) - m + 1)) for m in (1, 2, 3)]
    total, once = sum(grams[0].values()), sum(n == 1 for n in grams[0].values())
    unknown = (once + 0.5) / (total + 1)
    used = Counter()
    for m in (1, 2):
        for g, n in grams[m].items():
            used[g[:-1]] += n - 0.75 if n >= 2 else 0

    def p(g):
        if len(g) == 1:
            return (1 - unknown) * grams[0][g] / total if grams[0][g] else unknown
        c, n = grams[len(g) - 2][g[:-1]], grams[len(g) - 1][g]
        return p(g[1:]) if c < 2 else (1 - used[g[:-1]] / c) * p(g[1:]) + ((n - 0.75) / c if n >= 2 else 0)

    return {i: sum(math.log10(p(tuple(t[max(0, k - 2) : k + 1]))) for k in range(len(t))) for i, t in toks.items()}


def test_scores_use_every_ngram_seen_twice(spark, monkeypatch):
    rng = np.random.default_rng(3)
    # each rare word makes up less than 1e-4 of the tokens, its pairs are seen two to four times
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 250) % 3000)) for i in range(150)]
    rows += [(1000 + i, f"Rare{i % 40} pair{i % 40} follows{i % 40} w1") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 20_000)  # several chunks a task
    got = {r.doc_id: r.score for r in lm_score.op9(df).collect()}
    want = brute_scores(rows, lm_score.held_out)
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = lower_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows, vocabulary = [], [f"w{i}" for i in range(300)]
    passage = list(rng.choice(vocabulary, 30))
    for _ in range(8):
        first = [*rng.choice(vocabulary, 80), *passage]
        for _ in range(7):  # an original and copies edited by chance
            own = [w if rng.random() > 0.02 else "edit" + str(rng.integers(99)) for w in first]
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, "A b", "a B", "a b c", rows[0][1], rows[0][1].upper()])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op10(df.repartition(3)).collect()}
    assert got == brute_components(rows)
    kept = {r.doc_id for r in jaccard.keep_first(df).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = lower_words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())
    different = sorted(set(sets.values()), key=sorted)
    near = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    return {frozenset((x, y)) for k, x in enumerate(different) for y in different[k + 1 :] if x and y and near(x, y)}, sets


def test_links_between_classes_are_complete(spark, monkeypatch):
    rng = np.random.default_rng(7)
    first, rows = list(rng.choice([f"w{i}" for i in range(500)], 120)), []
    for k in range(45):  # a group of near copies, sizes from 60 to 120 words
        own = [w if rng.random() > 0.015 else f"e{rng.integers(99)}" for w in first[: 60 + k]]
        rows.append((len(rows), " ".join(own)))
    rows += [(100, rows[3][1]), (101, rows[3][1].upper()), (None, rows[5][1]), (102, "a b"), (103, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, sets = brute_links([(k, t) for k, (_, t) in enumerate(rows)])
    for hot in (2000, 5):  # plain tiles, and tiles dealt over salts
        monkeypatch.setattr(jaccard, "HOT_ROWS", hot)
        pairs, member = jaccard.links(df)
        nodes = {}
        for r, (i, t) in zip(sorted(member.collect(), key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
            nodes[r.node] = sets[rows.index((i, t))]
        got = [frozenset((nodes[r.a], nodes[r.b])) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op10(df).collect()}
        assert {i: c for i, c in found.items() if i is not None} == {i: c for i, c in brute_components([r for r in rows if r[0] is not None]).items()}


def test_pairs_met_under_different_salts_link(spark, monkeypatch):
    rows = []
    for k in range(24):  # pairs that meet only each other, so each node is alone under its salt unless both have the same
        rows += [(2 * k, " ".join(f"w{k}x{i}" for i in range(40))), (2 * k + 1, " ".join(f"w{k}x{i}" for i in range(41)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for salts in (1, 2, 255):
        monkeypatch.setattr(jaccard, "_salts", lambda levels, usual, n=salts: np.full(len(levels), n))
        assert {r.doc_id: r.component_id for r in jaccard.op10(df).collect()} == {i: i // 2 * 2 for i, _ in rows}
        assert jaccard.links(df)[0].count() == 24
    assert (jaccard.dealt(510, np.array([1, 2, 255])) == [0, 1, 1]).all()


def test_keep_first_keeps_unrelated_texts_and_clashing_columns(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, one, 1), (1, two, 2), (2, three, 3), (3, three + " more", 4), (4, one, 5), (4, one, 5), (None, two + " x", 6), (None, None, 7), (None, None, 7), (5, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h int").withColumnRenamed("h", "_keep").withColumn("node", F.lit(0))
    out = jaccard.keep_first(df.repartition(3))
    kept = sorted(((r.doc_id, r.text, r._keep) for r in out.collect()), key=str)
    assert out.columns == df.columns and kept == sorted([rows[0], rows[1], rows[2], rows[7], rows[8], rows[9]], key=str)
    assert jaccard.keep_first(df.limit(0)).count() == 0
    only_null = spark.createDataFrame([(None, one), (None, one + " x"), (None, one)], "doc_id long, text string")
    assert jaccard.keep_first(only_null).count() == 1 and {r.component_id for r in jaccard.op10(only_null).collect()} == {None}


def test_null_ids_link_others(spark):
    words_ = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words_)), (None, " ".join(words_[12:])), (2, " ".join(words_[24:]))]
    got = {r.doc_id: r.component_id for r in jaccard.op10(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, None: 1}


def test_very_long_texts(spark):
    """A text of some megabytes through every operator on documents."""
    rng = np.random.default_rng(4)
    long = " ".join(f"w{i}" for i in rng.integers(0, 5000, 400_000))
    rows = [(0, long, "a"), (1, long + " end", "a"), (2, "x" * 2_000_000, "b"), (3, "short", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ids = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.op1(df, JSON).collect()}
    assert ids[0][0] > 400_000 and ids[1][0] > ids[0][0]
    got = {r.doc_id: r for r in byte_bpe.op6(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert got[0].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest() and got[0].n_tokens == ids[0][0] - 1
    assert got[2].decoded_sha256 == hashlib.sha256(rows[2][1].encode()).hexdigest()
    assert {r.doc_id: r.n_words for r in quality.op3(df).collect()} == {0: 400_000, 1: 400_001, 2: 1, 3: 1}
    assert {r.doc_id: r["size"] for r in sharding.op2(df).collect()}[2] == 2_000_001
    assert {r.doc_id: r.n_tokens for r in lm_score.op9(df).collect()} == {0: 400_001, 1: 400_002, 2: 2, 3: 2}
    assert {r.doc_id: r.component_id for r in jaccard.op10(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    assert sum(r.taken for r in mixing.op4(df).collect()) > 0


def test_jaccard_edges(docs, empty):
    out = jaccard.op10(docs).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[0] == {(0, 0)} and by[4] == {(1, 3)} and by[6] == by[5] == {(10, 5)} and by[None] == {(2, None)}
    assert jaccard.op10(empty).count() == 0


def test_bitmap_bound_holds():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in "ab")
        assert jaccard.overlap_bound(jaccard.signature(a), len(a), jaccard.signature(b), len(b)) >= len(np.intersect1d(a, b))


def test_pieces_met_again_are_not_forgotten_with_the_rest():
    asked = []

    def encode(some):
        asked.extend(some)
        return [[len(p), ord(p[-1])] if p else [] for p in some]

    encoder, plain = PieceEncoder(encode, limit=40), PieceEncoder(lambda some: [[len(p), ord(p[-1])] if p else [] for p in some], limit=10**6)
    for k in range(30):
        texts = pa.array([f"the cat{k} sat, on\nmat{k} the dog{k}", None, "", f"the  cat{k}"])
        (ids, bounds), (want, ends) = encoder(texts), plain(texts)
        assert ids.tolist() == want.tolist() and bounds.tolist() == ends.tolist()
        assert len(encoder.slots) == len(encoder.met) == len(encoder.ends) - 1 <= 40
        assert list(encoder.slots.values()) == list(range(len(encoder.slots)))
    assert asked.count(" sat") == asked.count(" the") == 1 and len(asked) > 80


def test_walk_searches_no_arc_of_the_empty_context(monkeypatch):
    rng, n, log = np.random.default_rng(3), 50, lambda size: np.log10(rng.uniform(0.01, 0.9, size))
    pairs = np.unique(np.concatenate([np.arange(n), n + rng.choice(n * n, 400, replace=False)]))  # states 1 .. n are the words' own
    to = 1 + pairs % n
    made = lm_score.Automaton(n, pairs, to, log(len(pairs)), np.zeros(n + 1, np.int64), np.r_[0.0, log(n)], 2)
    searched, place = [], lm_score._place
    monkeypatch.setattr(lm_score, "_place", lambda keys, wanted: searched.extend(wanted.tolist()) or place(keys, wanted))
    words, bounds = rng.integers(0, n, 700).astype(np.int32), np.array([0, 1, 400, 700])
    got, arcs, want = made.walk(words, bounds), dict(zip(pairs.tolist(), made.logs.tolist(), strict=True)), []
    for k, w in enumerate(words.tolist()):
        state = 0 if k in bounds else 1 + int(words[k - 1])
        want.append(arcs.get(state * n + w) if state * n + w in arcs else made.fail_logs[state] + arcs[w])
    assert np.allclose(got, want, rtol=0, atol=1e-12)
    assert searched and min(searched) >= n
