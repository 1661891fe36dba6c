"""Queries of this package and, where SQL can express them, the SQL to hold them against."""

from __future__ import annotations

from windrow.llm import chat, decontamination, fill_in_middle, line_dedup, minhash, ngram_join, vector_codes, warc
from windrow.llm.bpe import op2_bpe_roundtrip
from windrow.llm.chat import op6_chat_formatting
from windrow.llm.decontamination import op10_decontamination
from windrow.llm.fill_in_middle import op13_fill_in_middle
from windrow.llm.html import op9_html_extraction
from windrow.llm.line_dedup import op11_line_dedup
from windrow.llm.minhash import minhash_near_duplicates, op3_minhash_fingerprints
from windrow.llm.ngram_join import op5_ngram_jaccard
from windrow.llm.pii import op4_pii_sanitisation
from windrow.llm.quality import op1_quality_classifier
from windrow.llm.toxicity import op8_toxicity_grammar
from windrow.llm.vector_codes import op12_vector_codes
from windrow.llm.warc import op7_warc_archives

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_bpe_roundtrip": op2_bpe_roundtrip,
    "op3_minhash_fingerprints": op3_minhash_fingerprints,
    "minhash_near_duplicates": minhash_near_duplicates,
    "op4_pii_sanitisation": op4_pii_sanitisation,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_warc_archives": op7_warc_archives,
    "op8_toxicity_grammar": op8_toxicity_grammar,
    "op9_html_extraction": op9_html_extraction,
    "op10_decontamination": op10_decontamination,
    "op11_line_dedup": op11_line_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES = {
    "minhash_near_duplicates": minhash.ORACLE_NEAR,
    "op10_decontamination": decontamination.ORACLE,
    "op11_line_dedup": line_dedup.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
    "op5_ngram_jaccard": ngram_join.ORACLE,
    "op6_chat_formatting": chat.ORACLE,
    "op7_warc_archives": warc.ORACLE,
}
