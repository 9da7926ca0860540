"""The queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from weftgraph.llm import decontaminate, htmltext, jaccard, maxproduct, middle, mixing, negatives, packing, repeats, resampling, sharding, tokencount, warc


def queries() -> dict:
    """Query name to function of (spark, sf_dir)."""
    found = [htmltext.op1_extract, warc.op2_warc, jaccard.op3_near, sharding.op4_shards, tokencount.op5_token_counts, decontaminate.op6_contaminated, repeats.op7_repeats, maxproduct.op8_top_products, resampling.op9_resample, packing.op10_pack, negatives.op11_hard_negatives, mixing.op12_mix, middle.op13_fim]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {"op2_warc": warc.ORACLE, "op3_near": jaccard.ORACLE, "op6_contaminated": decontaminate.ORACLE, "op4_shards": sharding.ORACLE, "op8_top_products": maxproduct.ORACLE, "op11_hard_negatives": negatives.ORACLE, "op12_mix": mixing.ORACLE, "op13_fim": middle.ORACLE}
