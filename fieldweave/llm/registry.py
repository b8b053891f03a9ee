"""Queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from fieldweave.llm import centroids, compact_windows, decontamination, edit_fingerprint, license_scan, personal_data, pieces, prefix_trie, secret_scan, sharding, simhash, suffix_dedup, toxicity


def queries():
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_sentencepiece": pieces.op4_sentencepiece,
        "op5_simhash_dedup": simhash.op5_simhash_dedup,
        "op6_sharding": sharding.op6_sharding,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_edit_fingerprint": edit_fingerprint.op8_edit_fingerprint,
        "op9_compact_windows": compact_windows.op9_compact_windows,
        "op10_secret_scan": secret_scan.op10_secret_scan,
        "op11_personal_data": personal_data.op11_personal_data,
        "op12_centroid_clustering": centroids.op12_centroid_clustering,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql():
    return license_scan.ORACLE | decontamination.ORACLE | centroids.ORACLE | prefix_trie.ORACLE
