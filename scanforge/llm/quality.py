"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document.  The ledger keeps the measurements and one
bit for each rule that failed, so policies (sets of rules that reject) are versioned masks
and what-if questions are bitwise aggregations that never read the text again.

Plan: one projection over the scan, no shuffle, no Python.  The 5-word windows of a text are
64-bit hashes within one row; texts without a repeated window, which is most, stop at a
hash-set distinct, so the sort is paid only where a window repeats.

Defined cases: a null or empty text has no words and fails ``few_words``; rows are judged one
by one, so repeated rows give repeated results, ties there are none; an empty table gives an empty
result; further columns, whatever their names, pass through ``ledger`` untouched and the ledger's
own columns replace any of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import LOWER, UPPER, let, words_of

WINDOW = 5

#: Bit of each rule, in the order of evaluation.
RULES = ("few_words", "repeated_windows", "word_length", "symbols", "duplicate_lines", "few_letters", "few_stop_words", "bullet_lines", "ellipsis_lines", "unended_lines")

#: Words that English prose cannot do without.
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "standard-1": ("few_words", "repeated_windows", "word_length", "symbols", "duplicate_lines"),
    # for any language; reject what is a list, cut off or not text
    "strict-1": ("few_words", "repeated_windows", "word_length", "symbols", "duplicate_lines", "few_letters", "bullet_lines", "ellipsis_lines"),
    # for English prose
    "english-1": RULES,
}

#: What the ledger measures of each text.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_letter_words", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines", "n_ended_lines")


def mask_of(policy: str | tuple[str, ...]) -> int:
    """Bitmask of a policy's rules."""
    return sum(1 << RULES.index(rule) for rule in (POLICIES[policy] if isinstance(policy, str) else policy))


def _covered(sorted_starts: Column) -> Column:
    """How many words the windows at these ascending starts cover."""
    first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"))
    return F.aggregate(sorted_starts, first, step, lambda a: a["n"])


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        return F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))

    return _covered(F.array_sort(F.transform(let(pairs, twins), lambda x: x["i"])))


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window which the text holds twice or more, first occurrences included."""

    def of(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - WINDOW, F.lit(0)))
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))
        none = lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(_repeated(hs))
        return F.when(F.size(ws) <= WINDOW, 0).otherwise(let(hashes, none))

    return let(words, of)


#: One pass over the text each: a word from its first letter on, a stop word, the blanks at a line's start and end.
_LETTERS = r"[A-Za-z\x{80}-\x{10FFFF}][^\x20\x09-\x0D]*+"
_STOPS = rf"(?i)(?<![^\x20\x09-\x0D])(?:{'|'.join(STOP_WORDS)})(?![^\x20\x09-\x0D])"
_LINE_START, _LINE_END = r"(?<![^\n])[ \t\x0B\f\r]*+", r"[ \t\x0B\f\r]*+(?![^\n])"


def measurements(text: Column) -> Column:
    """One struct with all measurements of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\f\r"))) > 0)
    return let(
        words_of(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            let(lines, F.size).cast("long").alias("n_lines"),
            n_repeat_words(ws).cast("long").alias("n_repeat_words"),
            F.regexp_count(text, F.lit(_LETTERS)).cast("long").alias("n_letter_words"),
            F.regexp_count(text, F.lit(_STOPS)).cast("long").alias("n_stop_words"),
            F.regexp_count(text, F.lit(rf"{_LINE_START}[\x{{2022}}*\-]")).cast("long").alias("n_bullet_lines"),
            F.regexp_count(text, F.lit(rf"(?:\.\.\.|\x{{2026}}){_LINE_END}")).cast("long").alias("n_ellipsis_lines"),
            F.regexp_count(text, F.lit(rf"[.!?\"'\x{{3002}}]{_LINE_END}")).cast("long").alias("n_ended_lines"),
        ),
    )


def failures() -> dict[str, Column]:
    """For each rule, whether the measured document fails it."""
    m = F.col
    return {
        "few_words": m("n_words") < 10,
        "repeated_windows": 100 * m("n_repeat_words") > 20 * m("n_words"),
        "word_length": (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 14 * m("n_words")),
        "symbols": 10 * m("n_symbols") > 2 * m("n_words"),
        "duplicate_lines": 100 * m("n_dup_lines") > 40 * m("n_lines"),
        "few_letters": 100 * m("n_letter_words") < 80 * m("n_words"),
        "few_stop_words": m("n_stop_words") < 2,
        "bullet_lines": 100 * m("n_bullet_lines") > 90 * m("n_lines"),
        "ellipsis_lines": 100 * m("n_ellipsis_lines") > 30 * m("n_lines"),
        "unended_lines": 100 * m("n_ended_lines") < 10 * m("n_lines"),
    }


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed_rules``, the bits of all rules that the document fails."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (*MEASURES, "failed_rules")])
    measured = docs.select(whole.alias("row"), measurements(F.col(text_col)).alias("m")).select("row", *[F.col(f"m.{n}").alias(n) for n in MEASURES])
    bits = [F.when(fails, F.lit(1 << RULES.index(rule))).otherwise(F.lit(0)) for rule, fails in failures().items()]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return measured.select("row.*", *MEASURES, mask.cast("int").alias("failed_rules"))


def passes(policy: str | tuple[str, ...]) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed_rules").bitwiseAND(F.lit(mask_of(policy))) == 0


def ablations(ledger_rows: DataFrame, policy: str | tuple[str, ...] = "standard-1") -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone (kept without the rule), and that stay.

    The ledger is first aggregated to its distinct masks (2**rules at most), map side first.
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    whole = mask_of(names)
    masks = ledger_rows.groupBy(F.col("failed_rules").bitwiseAND(F.lit(whole)).alias("mask")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).alias("bit")) for r in names]))
    count_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return (
        masks.select("mask", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            count_if(F.col("mask").bitwiseAND(F.col("r.bit")) != 0).alias("failing"),
            count_if(F.col("mask") == F.col("r.bit")).alias("failing_alone"),
            count_if(F.col("mask").bitwiseAND(F.lit(whole).bitwiseXOR(F.col("r.bit"))) == 0).alias("kept_without"),
        )
    )


def op3(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    base_failed = ~passes("base-1")
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), passes("standard-1").alias("kept"), "failed_rules",
    )


def ablation_report(docs: DataFrame, policy: str = "strict-1") -> DataFrame:
    """The policy's ablations over all documents."""
    return ablations(ledger(docs.select("doc_id", "text")), policy)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         row_number() OVER () AS rid
  FROM documents),
windows AS (SELECT rid, i, list_slice(w, i, i + 4) AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS n_letter_words,
         len(list_filter(w, lambda x: translate(x, '{UPPER}', '{LOWER}') IN {STOP_WORDS})) AS n_stop_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t\x0B\f\r]*[\x{{2022}}*\-]'))) AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[ \t\x0B\f\r]*$'))) AS n_ellipsis_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '[.!?"''\x{{3002}}][ \t\x0B\f\r]*$'))) AS n_ended_lines
  FROM d LEFT JOIN covered USING (rid)),
f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 2 * n_words THEN 8 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 16 ELSE 0 END)
    + (CASE WHEN 100 * n_letter_words < 80 * n_words THEN 32 ELSE 0 END) + (CASE WHEN n_stop_words < 2 THEN 64 ELSE 0 END)
    + (CASE WHEN 100 * n_bullet_lines > 90 * n_lines THEN 128 ELSE 0 END) + (CASE WHEN 100 * n_ellipsis_lines > 30 * n_lines THEN 256 ELSE 0 END)
    + (CASE WHEN 100 * n_ended_lines < 10 * n_lines THEN 512 ELSE 0 END) AS bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed,
       (bits & 31) = 0 AS kept, bits::INTEGER AS failed_rules
FROM f
"""

#: How many documents each rule of the strict policy rejects, rejects alone, and would be kept without it.
ABLATION_ORACLE = ORACLE[: ORACLE.rindex("SELECT doc_id, n_words")] + f"""
, r(rule, bit) AS (VALUES {", ".join(f"('{r}', {1 << RULES.index(r)})" for r in POLICIES["strict-1"])}),
x AS (SELECT bits & {mask_of("strict-1")} AS mask FROM f)
SELECT rule, (count(*) FILTER (mask & bit <> 0))::BIGINT AS failing, (count(*) FILTER (mask = bit))::BIGINT AS failing_alone,
       (count(*) FILTER (mask & ~bit = 0))::BIGINT AS kept_without
FROM r, x GROUP BY rule
"""
