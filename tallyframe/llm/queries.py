"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op6_bpe
from .embedding_dedup import OP9_SQL, op9_embedding_dedup
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .language_id import op8_language_id
from .license_scan import op5_license_scan
from .lm_score import op1_lm_score
from .ngram_join import OP3_SQL, op3_ngram_join
from .packing import op4_packing
from .quality import op10_quality
from .suffix_dedup import OP2_SQL, op2_suffix_dedup


def queries():
    return {f.__name__: f for f in (op1_lm_score, op2_suffix_dedup, op3_ngram_join, op4_packing, op5_license_scan, op6_bpe, op7_exact_dedup, op8_language_id, op9_embedding_dedup, op10_quality)}


def oracle_sql():
    return {"op2_suffix_dedup": OP2_SQL, "op3_ngram_join": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op9_embedding_dedup": OP9_SQL}
