"""Queries of the subpackage and the DuckDB twins of those that SQL can express."""

from __future__ import annotations

from medoidlab.llm.conversation_repair import op12_conversation_repair
from medoidlab.llm.conversation_repair_sql import OP12_SQL
from medoidlab.llm.decontamination import op2_decontamination
from medoidlab.llm.html_text import op7_html_text
from medoidlab.llm.minhash import op3_minhash_near_dedup
from medoidlab.llm.packing import op9_packing
from medoidlab.llm.preferences import OP10_SQL, op10_preferences
from medoidlab.llm.secret_scan import op13_secret_scan
from medoidlab.llm.sharding import op4_hilbert_sharding
from medoidlab.llm.spelling import op11_spelling_variants
from medoidlab.llm.spelling_sql import OP11_SQL
from medoidlab.llm.token_counts import op6_token_counts
from medoidlab.llm.topk import OP5_SQL, op5_cover_tree_topk
from medoidlab.llm.toxicity import op1_fm_toxicity
from medoidlab.llm.warc import OP8_SQL, op8_warc_archive


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_fm_toxicity": op1_fm_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_hilbert_sharding": op4_hilbert_sharding,
    "op5_cover_tree_topk": op5_cover_tree_topk,
    "op6_token_counts": op6_token_counts,
    "op7_html_text": op7_html_text,
    "op8_warc_archive": op8_warc_archive,
    "op9_packing": op9_packing,
    "op10_preferences": op10_preferences,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_secret_scan": op13_secret_scan,
    "pipeline": pipeline,
}

ORACLES = {
    "op5_cover_tree_topk": OP5_SQL,
    "op8_warc_archive": OP8_SQL,
    "op10_preferences": OP10_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
}
