"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from .decontaminate import op5_decontamination
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .html_extract import op3_html_extract
from .license_scan import OP6_SQL, op6_license_scan
from .line_dedup import OP2_SQL, op2_line_dedup
from .ngram_join import op1_ngram_join
from .packing import op8_best_fit_packing
from .quality import op10_quality_classifier
from .repair import op13_conversation_repair
from .token_counts import op7_token_counts
from .toxicity import op12_toxicity
from .url_filter import op9_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_line_dedup, op3_html_extract, op4_exact_dedup, op5_decontamination,
        op6_license_scan, op7_token_counts, op8_best_fit_packing, op9_url_filter, op10_quality_classifier,
        op11_hard_negatives, op12_toxicity, op13_conversation_repair,
    )
}
SQL = {"op2_line_dedup": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op6_license_scan": OP6_SQL, "op11_hard_negatives": OP11_SQL}
