"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, langid, lm_score, media_ts, minhash_dedup, packing, pii, spotsigs, suffix_dedup, url_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_spotsigs": spotsigs.query,
        "op2_lm_score": lm_score.query,
        "op3_langid": langid.query,
        "op4_url_rules": url_rules.query,
        "op5_minhash": minhash_dedup.query,
        "op6_suffix": suffix_dedup.query,
        "op7_packing": packing.query,
        "op8_transport_stream": media_ts.query,
        "op9_bpe": bpe.query,
        "op10_pii": pii.query,
    }


def oracle_sql() -> dict[str, str]:
    """The rest take a tokenizer, a learned model or a byte format that SQL lacks."""
    return {"op5_minhash": minhash_dedup.SQL, "op6_suffix": suffix_dedup.SQL}
