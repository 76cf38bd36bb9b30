"""The queries of this subpackage and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from quadrille.llm import exact_dedup, licenses, mixing, neighbours, packing, quality, secrets, simhash, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_mixing": mixing.op2_mixing,
    "op3_nearest": neighbours.op3_nearest,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_packing": packing.op6_packing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_simhash": simhash.op8_simhash,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_quality": quality.op10_quality,
}

ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
}
