"""Queries of the training-data operators over the given tables, and the SQL that some of them must agree with."""

from __future__ import annotations

from urlgauge.llm.brown import op2_query
from urlgauge.llm.chat import OP6_SQL, op6_query
from urlgauge.llm.collocations import OP12_SQL, op12_query
from urlgauge.llm.decontaminate import op5_query
from urlgauge.llm.language import op7_query
from urlgauge.llm.near_duplicates import op3_query
from urlgauge.llm.oracles import CONTAMINATION, NEAR_DUPLICATES, REPEATED_BYTES, REPEATED_PHRASES
from urlgauge.llm.phrase_dedup import op10_query
from urlgauge.llm.pieces import op8_query
from urlgauge.llm.quality import op1_query
from urlgauge.llm.runs import op13_query
from urlgauge.llm.suffix_dedup import op4_query
from urlgauge.llm.top_k import OP9_SQL, op9_query
from urlgauge.llm.toxicity import op11_query

QUERIES = {
    "op1_quality": op1_query,
    "op2_brown": op2_query,
    "op3_near_duplicates": op3_query,
    "op4_suffix_dedup": op4_query,
    "op5_decontaminate": op5_query,
    "op6_chat": op6_query,
    "op7_language": op7_query,
    "op8_pieces": op8_query,
    "op9_top_k": op9_query,
    "op10_phrase_dedup": op10_query,
    "op11_toxicity": op11_query,
    "op12_collocations": op12_query,
    "op13_runs": op13_query,
}
ORACLES = {
    "op3_near_duplicates": NEAR_DUPLICATES,
    "op4_suffix_dedup": REPEATED_BYTES,
    "op5_decontaminate": CONTAMINATION,
    "op6_chat": OP6_SQL,
    "op9_top_k": OP9_SQL,
    "op10_phrase_dedup": REPEATED_PHRASES,
    "op12_collocations": OP12_SQL,
}
