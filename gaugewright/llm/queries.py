"""The training-data queries and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import cover_tree, mixing, warc
from .bpe_automaton import op7_bpe_automaton
from .chat import op9_chat_windows
from .iblt import op3_iblt_fingerprints
from .language import op8_language_id
from .lm_scoring import op1_ce_difference
from .merkle import op13_merkle_manifest
from .runs import op12_lyndon_runs
from .simhash import op6_simhash
from .telephony import op10_telephony
from .token_counts import op5_token_counts

QUERIES = {
    "op1_ce_difference": op1_ce_difference,
    "op2_warc_transactions": warc.op2_warc_transactions,
    "op3_iblt_fingerprints": op3_iblt_fingerprints,
    "op4_pareto_mixing": mixing.op4_pareto_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_simhash": op6_simhash,
    "op7_bpe_automaton": op7_bpe_automaton,
    "op8_language_id": op8_language_id,
    "op9_chat_windows": op9_chat_windows,
    "op10_telephony": op10_telephony,
    "op11_cover_tree": cover_tree.op11_cover_tree,
    "op12_lyndon_runs": op12_lyndon_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = warc.ORACLE_SQL | mixing.ORACLE_SQL | cover_tree.ORACLE_SQL
