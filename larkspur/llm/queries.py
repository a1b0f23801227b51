"""The registered queries of this subpackage, and DuckDB SQL where one can express them."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this package that has query(spark, sf_dir)
NAMES = {
    "op1_html_host_suffix_array": "html_extract",
    "op2_embedding_hnsw": "embedding_dedup",
    "op3_simhash_pigeonring": "simhash",
    "op4_lm_deleted_interpolation": "lm_scoring",
    "op5_toxicity_ftrl": "toxicity",
    "op6_fingerprint_canonical": "fingerprint",
    "op7_sentence_spans": "sentence_dedup",
    "op8_bpe_speculative": "bpe",
    "op9_mixing_systematic": "mixing",
    "op10_suffix_array_family": "suffix_dedup",
    "op11_fill_middle_markers": "fill_middle",
    "op12_byte_bpe_segment_tree": "byte_bpe",
    "op13_merkle_superblocks": "merkle",
}


def queries() -> dict:
    import corpus_pipeline

    out = {name: import_module(f"{__package__}.{module}").query for name, module in NAMES.items()}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from . import fill_middle, merkle, mixing

    return {"op9_mixing_systematic": mixing.ORACLE, "op11_fill_middle_markers": fill_middle.ORACLE, "op13_merkle_superblocks": merkle.ORACLE}
