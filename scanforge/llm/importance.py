"""Target-distribution importance resampling over hashed n-grams.

A text's features are its runs of 1 to ``max_n`` words, hashed to buckets by crc32.  A bucket's gain
is the logarithm of its smoothed share in the target texts over its share in the corpus, in thousandths,
floored.  A document's weight is the floored mean of its features' gains; with a Gumbel draw from the hash of its id added,
the highest scores are a sample without replacement in proportion to exp(weight / 1000).

Plan: the bucket array of a document comes from higher-order functions over its words.  The corpus is
counted once, map side first, so at most one row a bucket and task is shuffled.  The gains are a literal array
of ``n_buckets`` entries; scoring folds each bucket array over it within the scan, without exploding or shuffling.
Of the scored rows (narrow, written once) a count for each score gives the least score drawn, and only rows from there on are
put in order, by range.

Defined cases: a null or empty text, or one without words, has no features, weight 0, and is never drawn; an empty
corpus or target has no counts and gains of smoothing alone; rows are judged one by one, so repeated rows are drawn each;
rows that tie in score and id are ordered by n_features and then by position; a null id is hashed as no
characters and comes last of a tie; a text is read whole however long; further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import LOWER, UPPER, let, numbered, written

BUCKETS = 10_000
#: Java regular expression of what separates words, once A-Z are lower-cased.
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Documents with fewer words are not drawn, and so many of 100 are.
LEAST_WORDS, PERCENT = 20, 10


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT), "")


def _hashed(feature: Column, n_buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(n_buckets)).cast("int")


def buckets_of(words: Column, max_n: int = 1, n_buckets: int = BUCKETS) -> Column:
    """The bucket of each run of 1 to ``max_n`` consecutive words, repeats included."""

    def runs(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: i <= F.size(words) - n + 1)
        return F.transform(starts, lambda i: _hashed(F.array_join(F.slice(words, i, n), " "), n_buckets))

    single = F.transform(words, lambda w: _hashed(w, n_buckets))
    return F.concat(single, *map(runs, range(2, max_n + 1))) if max_n > 1 else single


def bucket_counts(texts: DataFrame, max_n: int = 1, n_buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has any."""
    features = let(words_of(F.col(f"`{text_col}`")), lambda ws: buckets_of(ws, max_n, n_buckets))
    return texts.select(F.explode(features).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, max_n: int = 1, n_buckets: int = BUCKETS, text_col: str = "text") -> list[int]:
    """Each bucket's gain; ``n_buckets`` rows reach the driver, whatever the tables' size."""
    spark = docs.sparkSession
    both = bucket_counts(docs, max_n, n_buckets, text_col).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(bucket_counts(target, max_n, n_buckets, text_col).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(spark.range(n_buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    counts = written(both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")), "importance-counts")
    whole = counts.agg((F.sum("s") + n_buckets).alias("all_s"), (F.sum("t") + n_buckets).alias("all_t"))
    gain = F.floor(1000 * F.ln((F.col("t") + 1) * F.col("all_s") / ((F.col("s") + 1) * F.col("all_t"))))
    rows = counts.crossJoin(F.broadcast(whole)).select("bucket", gain.alias("gain")).collect()  # one row; n_buckets rows
    return [gain for _, gain in sorted((r["bucket"], r["gain"]) for r in rows)]


def weight_of(buckets: Column, gain_list: list[int]) -> Column:
    """The floored mean of the buckets' gains; 0 without any."""
    table = F.expr(f"cast(split('{','.join(map(str, gain_list))}', ',') as array<bigint>)")  # folded to one literal
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda sum_, b: sum_ + F.element_at(table, b + 1))
    n = F.size(buckets).cast("long")
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(let(total, lambda s: ((s - F.pmod(s, F.greatest(n, F.lit(1)))) / F.greatest(n, F.lit(1))).cast("long")))


def noise_of(doc_id: Column, seed: str = "2024") -> Column:
    """A standard Gumbel draw from the id's hash, in thousandths, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, max_n: int = 1, n_buckets: int = BUCKETS, text_col: str = "text", id_col: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and eligible (enough words) of every row."""
    gain_list = gains(docs, target, max_n, n_buckets, text_col)
    words = words_of(F.col(f"`{text_col}`"))
    measured = let(words, lambda ws: let(buckets_of(ws, max_n, n_buckets), lambda bs: F.struct(F.size(bs).cast("long").alias("n_features"), weight_of(bs, gain_list).alias("weight"), (F.size(ws) >= least_words).alias("eligible"))))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), measured.alias("m")).select("doc_id", "m.*")
    return rows.select("doc_id", "n_features", "weight", (F.col("weight") + noise_of(F.col("doc_id"))).alias("score"), "eligible")


def draw(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``scored`` rows with ``rank`` (from 1, by descending score) of the drawn ones, null elsewhere."""
    levels = rows.where("eligible").groupBy("score").agg(F.count("*").alias("n")).collect()  # whole scores of a range that the gains bound: some 100 000 at most
    wanted = percent * sum(r["n"] for r in levels) // 100
    least, above = None, 0
    for score, n in sorted(((r["score"], r["n"]) for r in levels), reverse=True):
        if above >= wanted:
            break
        least, above = score, above + n
    never = F.lit(None).cast("long").alias("rank")
    if least is None:
        return rows.withColumn("rank", never)
    high = F.col("eligible") & (F.col("score") >= least)
    placed = numbered(rows.where(high), [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features"], row="rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") < wanted, F.col("rank") + 1))
    return placed.unionByName(rows.where(~high).withColumn("rank", never))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, max_n: int = 1, n_buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; the drawn ones have a rank."""
    return draw(written(scored(docs, target, max_n, n_buckets), "importance-scores"), percent).drop("eligible")


def op11(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The contract's columns."""
    return resample(docs, target)


#: crc32 of a distinct feature's bytes by the 256-entry table of the polynomial 0xEDB88320.
ORACLE = rf"""
WITH t8 AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS rid
  FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT rid, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM b),
words AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
bytes AS (SELECT word, hex(encode(word)) AS x, crc FROM words, t8),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x)::BIGINT, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM bytes),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE AS all_s, ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE AS all_t),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * all_s / ((coalesce(s, 0) + 1)::DOUBLE * all_t)))::BIGINT AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums),
f AS (SELECT rid, count(*) AS n, sum(gain)::BIGINT AS total FROM dw JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY rid),
m AS (
  SELECT doc_id, rid, coalesce(n, 0)::BIGINT AS n_features,
         CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN f USING (rid)),
scores AS (SELECT doc_id, rid, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM m),
r AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, rid) AS rank, count(*) OVER () AS n
  FROM scores WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END::BIGINT AS rank
FROM scores LEFT JOIN r USING (rid)
"""
