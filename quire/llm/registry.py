"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quire.llm.decontaminate import OP3_SQL, op3_decontaminate
from quire.llm.jaccard import OP6_SQL, op6_jaccard
from quire.llm.language import op4_language
from quire.llm.licenses import OP2_SQL, op2_licenses, op2_licenses_all_forms
from quire.llm.lines import OP12_SQL, op12_lines
from quire.llm.manifest import OP11_SQL, op11_merkle
from quire.llm.pieces import op7_sentencepiece, op9_token_counts
from quire.llm.prefixes import OP13_SQL, op13_prefixes
from quire.llm.quality import op1_quality
from quire.llm.rules import OP8_SQL, op8_rules
from quire.llm.toxicity import op10_toxicity
from quire.llm.urls import OP5_SQL, op5_urls

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_licenses,
        op2_licenses_all_forms,
        op3_decontaminate,
        op4_language,
        op5_urls,
        op6_jaccard,
        op7_sentencepiece,
        op8_rules,
        op9_token_counts,
        op10_toxicity,
        op11_merkle,
        op12_lines,
        op13_prefixes,
    )
}
SQL = {
    "op2_licenses": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
    "op5_urls": OP5_SQL,
    "op6_jaccard": OP6_SQL,
    "op8_rules": OP8_SQL,
    "op11_merkle": OP11_SQL,
    "op12_lines": OP12_SQL,
    "op13_prefixes": OP13_SQL,
}
