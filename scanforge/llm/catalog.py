"""One query for each operator, applied to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scanforge.llm import ann, byte_bpe, chat, importance, jaccard, lm_score, mixing, quality, search, sharding, simhash, token_files, url_filter
from scanforge.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def _over(name: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": _over("documents", partial(token_files.op1, tokenizer_path=TOKENIZER)),
        "op2_byte_shards": _over("documents", sharding.op2),
        "op3_quality_rules": _over("documents", quality.op3),
        "op3_rule_ablations": _over("documents", quality.ablation_report),
        "op4_mix_sources": _over("documents", mixing.op4),
        "op5_url_rules": _over("pages", url_filter.op5),
        "op6_byte_bpe": _over("documents", partial(byte_bpe.op6, ranks_path=RANKS, pattern=PATTERN)),
        "op7_additive_quantisation": _over("embeddings", ann.op7),
        "op8_reply_trees": _over("conversations", chat.op8),
        "op9_backoff_lm": _over("documents", lm_score.op9),
        "op10_jaccard_join": _over("documents", jaccard.op10),
        "op11_importance_resampling": lambda spark, sf_dir: importance.op11(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op12_lexical_search": lambda spark, sf_dir: search.op12(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op13_simhash_anchors": _over("documents", simhash.op13),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality.ORACLE,
        "op3_rule_ablations": quality.ABLATION_ORACLE,
        "op5_url_rules": url_filter.ORACLE,
        "op8_reply_trees": chat.ORACLE,
        "op10_jaccard_join": jaccard.ORACLE,
        "op11_importance_resampling": importance.ORACLE,
        "op12_lexical_search": search.ORACLE,
    }
