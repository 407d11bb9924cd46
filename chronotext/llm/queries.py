"""The queries opN_<name>, and DuckDB SQL for those that SQL can express."""
import corpus_pipeline

from . import chat, infill, lattice, repair, rollup
from .audio import op1_chroma
from .chat import op8_chat
from .decontaminate import op5_decontaminate
from .infill import op13_infill
from .jaccard import op3_ngram_join
from .lattice import op12_lattice
from .packing import op4_pack
from .quality import op9_quality
from .repair import op11_repair
from .rollup import op2_token_rollup
from .scoring import op7_context_tree
from .suffix_dedup import op6_suffix_dedup
from .toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (op1_chroma, op2_token_rollup, op3_ngram_join, op4_pack, op5_decontaminate, op6_suffix_dedup, op7_context_tree, op8_chat, op9_quality, op10_toxicity, op11_repair, op12_lattice, op13_infill)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE_SQL = {"op2_token_rollup": rollup.SQL, "op8_chat": chat.SQL, "op11_repair": repair.SQL, "op12_lattice": lattice.SQL, "op13_infill": infill.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
