"""Queries of this package's operators, and the SQL that checks them."""

from __future__ import annotations

from finscan.llm import chosen_path, language_id, license_scan, pfair_mix, pivot_topk, sentencepiece_bpe, style_tree, suffix_dedup, tiff, warc


def queries() -> dict:
    return {
        "op1_pivot_topk": pivot_topk.op1_pivot_topk,
        "op2_warc_roundtrip": warc.op2_warc_roundtrip,
        "op3_sentencepiece": sentencepiece_bpe.op3_sentencepiece,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_tiff_pages": tiff.op5_tiff_pages,
        "op6_style_tree": style_tree.op6_style_tree,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_pfair_mix": pfair_mix.op8_pfair_mix,
        "op9_chosen_path_join": chosen_path.op9_chosen_path_join,
        "op10_language_id": language_id.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pivot_topk": pivot_topk.OP1_SQL,
        "op2_warc_roundtrip": warc.OP2_SQL,
        "op7_license_scan": license_scan.OP7_SQL,
        "op8_pfair_mix": pfair_mix.OP8_SQL,
    }
