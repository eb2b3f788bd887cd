"""The queries of this subpackage and the SQL of those that SQL can express."""

from clarispark.llm.chat import OP2_SQL, op2_chat_formatting
from clarispark.llm.decontamination import op6_benchmark_decontamination
from clarispark.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from clarispark.llm.html_layout import op8_html_extraction
from clarispark.llm.line_dedup import OP10_SQL, op10_line_dedup
from clarispark.llm.packing import op1_best_fit_packing
from clarispark.llm.quality import op3_quality
from clarispark.llm.simhash import op7_simhash_near_dedup
from clarispark.llm.toxicity import op5_toxicity
from clarispark.llm.warc import op4_warc_derivatives

QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_chat_formatting, op3_quality, op4_warc_derivatives, op5_toxicity, op6_benchmark_decontamination,
        op7_simhash_near_dedup, op8_html_extraction, op9_exact_dedup, op10_line_dedup,
    )
}
ORACLE_SQL = {"op2_chat_formatting": OP2_SQL, "op9_exact_dedup": OP9_SQL, "op10_line_dedup": OP10_SQL}
