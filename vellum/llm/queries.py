"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .additive import op1_neighbours
from .decontaminate import op4_decontaminate
from .hmm import op2_hmm
from .jaccard import OP3_SQL, op3_jaccard
from .langid import op6_language
from .licences import OP7_SQL, op7_licences
from .mixing import OP10_SQL, op10_mix
from .toxicity import op5_toxicity
from .urlfilter import OP9_SQL, op9_url_rules
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op3_jaccard": op3_jaccard,
    "op2_hmm": op2_hmm,
    "op1_neighbours": op1_neighbours,
    "op8_warc": op8_warc,
    "op6_language": op6_language,
    "op5_toxicity": op5_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op7_licences": op7_licences,
    "op9_url_rules": op9_url_rules,
    "op10_mix": op10_mix,
}

SQL = {
    "op3_jaccard": OP3_SQL,
    "op8_warc": OP8_SQL,
    "op7_licences": OP7_SQL,
    "op9_url_rules": OP9_SQL,
    "op10_mix": OP10_SQL,
}
