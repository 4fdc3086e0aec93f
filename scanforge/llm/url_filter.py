"""URL rules in a sorted digest array.

The rules become one memory-mapped file: ascending 64-bit xxhash keys of ``host + path``, and
the full rule strings.  A URL is probed with each suffix of its host at a label boundary, joined to
each path prefix of a length that some rule has: all probes of a batch go through one
vectorised binary search, and the stored string must equal the probe, so a digest collision
never decides.  The longest rule wins, then the one with the longer host.

The file lies in the shared folder and is sent by ``SparkContext.addFile``, so executors map it from
their own disk and share its pages between workers.  ``MOST_RULE_BYTES`` bounds it; the scan reads the id and
url columns alone and nothing is shuffled.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no
rule; repeated rows are judged one by one; of rules that fit and are equally long the one with the longer
host wins; an empty table gives an empty result; further columns, whatever their names, are kept.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.llm.common import LOWER, UPPER, shared_dir

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The verdict where no rule fits: the filter is a block list with exceptions.
DEFAULT = "allow"
MOST_RULE_BYTES = 2 << 30


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class DigestArray:
    """The mapped arrays: ``digests`` ascending; rule i's UTF-8 text is ``blob[starts[i]:starts[i + 1]]``."""

    digests: np.ndarray
    starts: np.ndarray
    blocks: np.ndarray
    host_bytes: np.ndarray
    blob: np.ndarray
    path_lengths: tuple[int, ...]

    @staticmethod
    def save(rules: Iterable[tuple[str, str, str]], path: str) -> None:
        made: dict[str, tuple[str, str]] = {}
        for host, prefix, verdict in rules:
            made[host.translate(str.maketrans(UPPER, LOWER)) + prefix] = (host, verdict)
        texts = sorted(made, key=lambda s: xxhash.xxh64_intdigest(s.encode()))
        raw = [s.encode() for s in texts]
        starts = np.cumsum([0, *map(len, raw)], dtype="<i8")
        digests = np.array([xxhash.xxh64_intdigest(b) for b in raw], dtype="<u8")
        blocks = np.array([made[s][1] == "block" for s in texts], dtype="u1")
        hosts = np.array([len(made[s][0].encode()) for s in texts], dtype="<i4")
        blob = b"".join(raw)
        if len(blob) > MOST_RULE_BYTES:
            raise ValueError(f"rules of {len(blob)} bytes; {MOST_RULE_BYTES} are the most")
        lengths = np.array(sorted({len(s) - len(made[s][0]) for s in texts}), dtype="<i4")
        with open(path, "wb") as f:
            f.write(np.array([len(texts), len(blob), len(lengths)], dtype="<i8").tobytes())
            for part in (digests, starts, hosts, lengths, blocks):
                f.write(part.tobytes())
            f.write(blob)

    @classmethod
    def load(cls, path: str) -> DigestArray:
        n, size, k = np.fromfile(path, dtype="<i8", count=3)
        raw, at, parts = np.memmap(path, mode="r"), 24, []
        for count, kind in ((n, "<u8"), (n + 1, "<i8"), (n, "<i4"), (k, "<i4"), (n, "u1"), (size, "u1")):
            end = at + int(count) * np.dtype(kind).itemsize
            parts.append(raw[at:end].view(kind))
            at = end
        return cls(parts[0], parts[1], parts[4], parts[2], parts[5], tuple(map(int, parts[3])))

    def find(self, probes: list[str]) -> np.ndarray:
        """Index of the rule equal to each probe, or -1."""
        if not len(self.digests) or not probes:
            return np.full(len(probes), -1)
        raw = [p.encode() for p in probes]
        keys = np.fromiter(map(xxhash.xxh64_intdigest, raw), dtype="u8", count=len(raw))
        at = np.searchsorted(self.digests, keys)
        out = np.full(len(raw), -1)
        for j in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == keys):
            i = at[j]  # equal digests lie together
            while i < len(self.digests) and self.digests[i] == keys[j]:
                if self.blob[self.starts[i] : self.starts[i + 1]].tobytes() == raw[j]:
                    out[j] = i
                    break
                i += 1
        return out

    def judge(self, hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        """rule and verdict (null where no rule fits) of each URL."""
        memo: dict[tuple[str, str], int] = {}
        cut = max(self.path_lengths, default=0)
        keys = list(zip(hosts, (p[:cut] for p in paths), strict=True))
        fresh = list(dict.fromkeys(keys))
        probes, owner = [], []
        for k, (host, path) in enumerate(fresh):
            labels = host.split(".")
            for suffix in (".".join(labels[i:]) for i in range(len(labels))) if host else ():
                for length in self.path_lengths:
                    if length <= len(path):
                        probes.append(suffix + path[:length])
                        owner.append(k)
        best: dict[int, int] = {}
        for k, i in zip(owner, self.find(probes), strict=True):
            if i >= 0 and (k not in best or self._rank(i) > self._rank(best[k])):
                best[k] = i
        memo = {key: best.get(k, -1) for k, key in enumerate(fresh)}
        hits = [memo[k] for k in keys]
        text = lambda i: self.blob[self.starts[i] : self.starts[i + 1]].tobytes().decode()
        return pd.DataFrame(
            {"rule": [text(i) if i >= 0 else None for i in hits], "verdict": [("allow", "block")[self.blocks[i]] if i >= 0 else None for i in hits]},
            dtype=object,
        )

    def _rank(self, i: int) -> tuple[int, int]:
        return int(self.starts[i + 1] - self.starts[i]), int(self.host_bytes[i])


def _shipped(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Name of the rules' file, put into the shared folder, from where each executor fetches it once."""
    with tempfile.TemporaryDirectory(prefix="url-rules-") as folder:
        local = os.path.join(folder, "rules.bin")
        DigestArray.save(rules, local)
        with open(local, "rb") as f:
            name = f"url-rules-{hashlib.sha256(f.read()).hexdigest()}.bin"  # equal rules are one file
        jvm, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.Path(f"{shared_dir(spark).rstrip('/')}/scanforge/{name}")
        system = target.getFileSystem(conf)
        if not system.exists(target):
            system.copyFromLocalFile(False, True, jvm.Path(f"file://{local}"), target)
        spark.sparkContext.addFile(system.makeQualified(target).toString())
    return name


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT, url_col: str = "url", out: str = "judged") -> DataFrame:
    """``pages`` with a struct column ``out`` (host, path, rule, verdict), which replaces one of that name."""
    name = _shipped(pages.sparkSession, rules)

    @F.pandas_udf("rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = DigestArray.load(SparkFiles.get(name))
        for hosts, paths in batches:
            yield index.judge(hosts, paths)

    url = F.col(f"`{url_col}`")
    whole = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != out])
    parts = pages.select(whole.alias("page"), host_of(url).alias("host"), path_of(url).alias("path"))
    parts = parts.withColumn("found", judged("host", "path"))
    verdict = F.coalesce(F.col("found.verdict"), F.lit(default)).alias("verdict")
    return parts.select("page.*", F.struct("host", "path", F.col("found.rule").alias("rule"), verdict).alias(out))


def op5(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return filter_urls(pages.select("page_id", "url")).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS rid FROM u),
r(h, x, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hit AS (
  SELECT rid, h || x AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(h || x) DESC, length(h) DESC) AS k
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN hit ON p.rid = hit.rid AND k = 1
"""
