"""Registered queries of the numbered operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, edit_counts, html_text, line_dedup, media, packing, phrases, quality, shards, simhash, sketches, token_codes, tree_bpe


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_codes": token_codes.op1_token_codes,
        "op2_tree_bpe": tree_bpe.op2_tree_bpe,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_adaptive_quality": quality.op4_adaptive_quality,
        "op5_minimax_shards": shards.op5_minimax_shards,
        "op6_edit_counts": edit_counts.op6_edit_counts,
        "op7_archive_media": media.op7_archive_media,
        "op8_tag_path_text": html_text.op8_tag_path_text,
        "op9_simhash_anchors": simhash.op9_simhash_anchors,
        "op10_hilbert_packing": packing.op10_hilbert_packing,
        "op11_toivonen_phrases": phrases.op11_toivonen_phrases,
        "op12_pair_alignment": alignment.op12_pair_alignment,
        "op13_bottom_k": sketches.op13_bottom_k,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.ORACLE_SQL, "op4_adaptive_quality": quality.ORACLE_SQL, "op11_toivonen_phrases": phrases.ORACLE_SQL}
