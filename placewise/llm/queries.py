"""The registered queries of these operators, and their SQL where SQL can say it."""

from placewise.llm.alignment import op12_token_alignment
from placewise.llm.byte_bpe import op10_byte_bpe
from placewise.llm.chat_format import OP6_SQL, op6_chat_format
from placewise.llm.decontamination import OP1_SQL, op1_decontamination
from placewise.llm.merkle import OP13_SQL, op13_merkle_manifest
from placewise.llm.near_duplicates import op9_near_duplicates
from placewise.llm.quality_crf import op3_quality
from placewise.llm.quality_rules import OP7_SQL, op7_quality_rules
from placewise.llm.sharding import op8_sharding
from placewise.llm.simhash import op11_simhash
from placewise.llm.token_counts import op4_token_counts
from placewise.llm.token_files import op2_token_files
from placewise.llm.url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_token_files,
        op3_quality,
        op4_token_counts,
        op5_url_filter,
        op6_chat_format,
        op7_quality_rules,
        op8_sharding,
        op9_near_duplicates,
        op10_byte_bpe,
        op11_simhash,
        op12_token_alignment,
        op13_merkle_manifest,
    )
}
ORACLES = {"op1_decontamination": OP1_SQL, "op5_url_filter": OP5_SQL, "op6_chat_format": OP6_SQL, "op7_quality_rules": OP7_SQL, "op13_merkle_manifest": OP13_SQL}
