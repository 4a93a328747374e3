"""The registered queries of this subpackage."""

from framelake.llm.additive import op2_additive
from framelake.llm.bpe import op7_byte_bpe
from framelake.llm.filters import OP12_SQL, op12_filter_audit
from framelake.llm.html import op5_html
from framelake.llm.huffman import op4_huffman_ids
from framelake.llm.jaccard import OP9_SQL, op9_ngram_jaccard
from framelake.llm.language import op8_language
from framelake.llm.lines import op3_line_dedup
from framelake.llm.mixture import op10_mixture
from framelake.llm.packing import op13_best_fit
from framelake.llm.toxicity import op6_toxicity
from framelake.llm.trie import op11_prefix_trie
from framelake.llm.webp import op1_webp

QUERIES = {
    "op1_webp": op1_webp,
    "op2_additive": op2_additive,
    "op3_line_dedup": op3_line_dedup,
    "op4_huffman_ids": op4_huffman_ids,
    "op5_html": op5_html,
    "op6_toxicity": op6_toxicity,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_language": op8_language,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_mixture": op10_mixture,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_filter_audit": op12_filter_audit,
    "op13_best_fit": op13_best_fit,
}

#: The others have no SQL: tests compare them with brute force, round trips or held-out labels.
ORACLE_QUERIES = {"op9_ngram_jaccard": OP9_SQL, "op12_filter_audit": OP12_SQL}
