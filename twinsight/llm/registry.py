"""Queries of the corpus operators, and their SQL where it can express them."""

from .chat_format import OP1_SQL, op1_chat_format
from .decontamination import op2_decontamination
from .language_id import op3_language_id
from .near_dedup import op4_near_dedup
from .packing import op7_best_fit_packing
from .quality_classifier import op9_quality_classifier
from .quality_rules import OP10_SQL, op10_quality_rules
from .secrets import op5_secret_scan
from .sstable import op6_token_shards
from .warc import op8_warc_archives

QUERIES = {f.__name__: f for f in (op1_chat_format, op2_decontamination, op3_language_id, op4_near_dedup, op5_secret_scan, op6_token_shards, op7_best_fit_packing, op8_warc_archives, op9_quality_classifier, op10_quality_rules)}
SQL = {"op1_chat_format": OP1_SQL, "op10_quality_rules": OP10_SQL}
