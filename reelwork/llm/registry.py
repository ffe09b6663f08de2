"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import attribution, decontamination, licenses, manifest, packing, periodic, pii, quality_classifier, quality_rules, sharding, simhash, warc, window_packing

QUERIES = {
    "op1_quality": quality_classifier.op1_quality,
    "op2_attribution": attribution.op2_attribution,
    "op3_packing": packing.op3_packing,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_licenses": licenses.op5_licenses,
    "op6_transactions": warc.op6_transactions,
    "op7_surrogates": pii.op7_surrogates,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_simhash": simhash.op9_simhash,
    "op10_resharding": sharding.op10_resharding,
    "op11_manifest": manifest.op11_manifest,
    "op12_windows": window_packing.op12_windows,
    "op13_runs": periodic.op13_runs,
}

SQL: dict[str, str] = {
    "op4_decontamination": decontamination.OP4_SQL,
    "op5_licenses": licenses.OP5_SQL,
    "op6_transactions": warc.OP6_SQL,
    "op11_manifest": manifest.OP11_SQL,
}
