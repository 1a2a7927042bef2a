"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from postlane.llm import language, line_rules, mixing, near_duplicates, packing, preference, repeats, secrets, syncmers, warc

QUERIES = {
    "op1_secret_crf": secrets.op1_secret_crf,
    "op2_suffix_family": repeats.op2_suffix_family,
    "op3_syncmers": syncmers.op3_syncmers,
    "op4_language": language.op4_language,
    "op5_pivotal_mixing": mixing.op5_pivotal_mixing,
    "op6_genetic_packing": packing.op6_genetic_packing,
    "op7_warc_chunks": warc.op7_warc_chunks,
    "op8_line_rules": line_rules.op8_line_rules,
    "op9_bradley_terry": preference.op9_bradley_terry,
    "op10_simhash_golay": near_duplicates.op10_simhash_golay,
}

ORACLE_SQL: dict[str, str] = {"op7_warc_chunks": warc.OP7_SQL, "op8_line_rules": line_rules.OP8_SQL}
