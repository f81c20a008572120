"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe_transducer, config_packing, crf_quality, exact_topk, filter_audit, language_id, line_templates, maxent_lm, minhash_join, rank_index, suffix_levels, token_files, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        line_templates.op1_line_templates,
        exact_topk.op2_exact_topk,
        minhash_join.op3_minhash_join,
        language_id.op4_language_id,
        token_files.op5_token_files,
        suffix_levels.op6_suffix_levels,
        config_packing.op7_config_packing,
        bpe_transducer.op8_bpe_transducer,
        maxent_lm.op9_maxent_lm,
        crf_quality.op10_crf_quality,
        filter_audit.op11_filter_audit,
        warc.op12_warc,
        rank_index.op13_fill_in_middle,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_templates": line_templates.OP1_SQL,
        "op2_exact_topk": exact_topk.OP2_SQL,
        "op11_filter_audit": filter_audit.OP11_SQL,
        "op12_warc": warc.OP12_SQL,
        "op13_fill_in_middle": rank_index.OP13_SQL,
    }
