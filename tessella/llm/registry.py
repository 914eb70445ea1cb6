"""The operators' queries and, where SQL can express them, their oracles."""

from tessella.llm.chat import op12_chat_windows
from tessella.llm.filter_audit import ORACLE_SQL as AUDIT_SQL
from tessella.llm.filter_audit import op13_filter_audit
from tessella.llm.langid import op10_nearest_centroid
from tessella.llm.late_overwrite import op11_late_overwrite
from tessella.llm.lm_scoring import op6_cross_entropy_difference
from tessella.llm.mixing import ORACLE_SQL, op4_pareto_mixture
from tessella.llm.near_dedup import op2_minhash_near_dedup
from tessella.llm.packing import op5_vector_best_fit
from tessella.llm.pii import op7_weak_supervision_pii
from tessella.llm.sharding import op9_kd_tree
from tessella.llm.spotsigs import op1_spotsigs
from tessella.llm.toxicity import op3_max_segment_toxicity
from tessella.llm.vector_search import op8_anisotropic_search

QUERIES = {f.__name__: f for f in (op1_spotsigs, op2_minhash_near_dedup, op3_max_segment_toxicity, op4_pareto_mixture, op5_vector_best_fit, op6_cross_entropy_difference, op7_weak_supervision_pii, op8_anisotropic_search, op9_kd_tree, op10_nearest_centroid, op11_late_overwrite, op12_chat_windows, op13_filter_audit)}
ORACLES = {"op4_pareto_mixture": ORACLE_SQL, "op13_filter_audit": AUDIT_SQL}
