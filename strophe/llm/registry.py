"""Queries of this subpackage and, where SQL can express one, its DuckDB form."""

from .bpe import op4_bpe
from .centroids import OP11_SQL, op11_centroid_clustering
from .conversations import OP13_SQL, op13_conversation_repair
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .language_id import op2_language_id
from .line_dedup import OP12_SQL, op12_line_dedup
from .packing import op8_packing
from .quality_cnn import op10_quality_cnn
from .quality_rules import op5_quality_rules
from .sharding import op7_sharding
from .simhash import op3_simhash
from .substring_dedup import op6_substring_dedup
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_cnn": op10_quality_cnn,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_line_dedup": op12_line_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {
    "op1_warc": OP1_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_centroid_clustering": OP11_SQL,
    "op12_line_dedup": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
