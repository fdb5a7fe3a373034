"""Registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from ruletrace.llm import (bpe, collocations, decontamination, language_model, license_scan, merkle, packing, quality_rules, simhash,
                           suffix_dedup, toxicity, url_filter, warc)

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_simhash": simhash.op5_simhash,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_lm_scoring": language_model.op8_lm_scoring,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_bpe": bpe.op11_bpe,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE = {"op1_warc": warc.ORACLE, "op9_quality_rules": quality_rules.ORACLE, "op12_merkle_manifest": merkle.ORACLE,
          "op13_collocations": collocations.ORACLE}
