"""The subpackage's queries and their SQL."""

from __future__ import annotations

from crawlsift.llm import align, ann, bpe, langid, lines, mixing, neardup, quality, recompress, topk, toxicity, trie, warc

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_exact_topk": topk.op2_exact_topk,
    "op3_quality": quality.op3_quality,
    "op4_warc": warc.op4_warc,
    "op5_bpe": bpe.op5_bpe,
    "op6_approximate_neighbours": ann.op6_approximate_neighbours,
    "op7_entropy_mixing": mixing.op7_entropy_mixing,
    "op8_language": langid.op8_language,
    "op9_ngram_join": neardup.op9_ngram_join,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_token_alignment": align.op11_token_alignment,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_substring_dedup": recompress.op13_substring_dedup,
}
ORACLES = {
    "op2_exact_topk": topk.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
    "op6_approximate_neighbours": ann.OP6_SQL,
    "op9_ngram_join": neardup.OP9_SQL,
    "op12_prefix_trie": trie.OP12_SQL,
    "op13_substring_dedup": recompress.OP13_SQL,
}
