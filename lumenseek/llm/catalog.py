"""Queries over the operators of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
from lumenseek.llm import ballkmeans, decontamination, extraction, fingerprints, jaccard, jpeg, packing, phrases, quality, secrets, simple8b, toxicity, warc


def queries():
    return {
        "pipeline": corpus_pipeline.run,
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_quality": quality.op2_quality,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_html_extraction": extraction.op4_html_extraction,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_warc": warc.op6_warc,
        "op7_jpeg": jpeg.op7_jpeg,
        "op8_simple8b": simple8b.op8_simple8b,
        "op9_jaccard_join": jaccard.op9_jaccard_join,
        "op10_packing": packing.op10_packing,
        "op11_fingerprints": fingerprints.op11_fingerprints,
        "op12_phrases": phrases.op12_phrases,
        "op13_ball_kmeans": ballkmeans.op13_ball_kmeans,
    }


def oracle_sql():
    return {"op3_decontamination": decontamination.ORACLE_SQL, "op6_warc": warc.ORACLE_SQL, "op9_jaccard_join": jaccard.ORACLE_SQL, "op12_phrases": phrases.ORACLE_SQL, "op13_ball_kmeans": ballkmeans.ORACLE_SQL}
