"""The queries of this package and their SQL."""

from __future__ import annotations

from . import language, lines, mixing, negatives, packing, quality, simhash, substrings, trees, urls, vectors, warc, whitening

QUERIES = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_repeats": substrings.op5_repeats,
    "op6_pack": packing.op6_pack,
    "op7_simhash": simhash.op7_simhash,
    "op8_language": language.op8_language,
    "op9_near_vectors": vectors.op9_near_vectors,
    "op10_warc": warc.op10_warc,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_whitening": whitening.op12_whitening,
    "op13_repeated_words": trees.op13_repeated_words,
}
SQL = {"op3_mix_sources": mixing.OP3_SQL, "op11_hard_negatives": negatives.OP11_SQL}
