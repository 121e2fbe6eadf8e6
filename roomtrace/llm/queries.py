"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from roomtrace.llm.exact_search import OP7_SQL, op7_exact_top_k
from roomtrace.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from roomtrace.llm.licenses import OP4_SQL, op4_license_scan
from roomtrace.llm.line_dedup import OP12_SQL, op12_line_dedup
from roomtrace.llm.mixing import OP3_SQL, op3_mix_sources
from roomtrace.llm.near_dedup import op8_near_duplicates
from roomtrace.llm.neighbours import op5_nearest
from roomtrace.llm.packing import op2_best_fit_packing
from roomtrace.llm.quality import op9_quality
from roomtrace.llm.secrets import op6_secret_scan
from roomtrace.llm.suffix_dedup import op1_suffix_dedup
from roomtrace.llm.token_counts import op10_token_counts
from roomtrace.llm.whitening import op13_whitening

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_mix_sources": op3_mix_sources,
    "op4_license_scan": op4_license_scan,
    "op5_nearest": op5_nearest,
    "op6_secret_scan": op6_secret_scan,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_line_dedup": op12_line_dedup,
    "op13_whitening": op13_whitening,
}
SQL = {"op3_mix_sources": OP3_SQL, "op4_license_scan": OP4_SQL, "op7_exact_top_k": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op12_line_dedup": OP12_SQL}
