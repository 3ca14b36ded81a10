"""Parameters under which the provided test tables give non-trivial results.

The default lexicon, fillers and section rules hardly occur in the synthetic
text, so the registered queries pass these instead (the operators are the
same; only their parameters differ).
"""

from __future__ import annotations

# Role keywords: the ``assistant`` speaker is the counselor.
ROLE_KEYWORDS = ["assistant"]

# Severity lexicon for the test text (trailing blanks are part of phrases).
LEXICON = {
    5: ["nicht", "para "],
    4: ["avec", "dans"],
    3: ["in the"],
    2: ["than", "la "],
}

# Section rules for the test text, in routing order; unmatched sentences go
# to ``insights``.
SECTION_RULES = [
    ("A", [r"(the|der|la) (of|die|de)[^.]*\."]),
    ("B", [r"(with|avec|nicht|para)[^.]*\."]),
    ("C", [r"(from|than|que)[^.]*\."]),
    ("D", [r"^(in|en) [^.]*\."]),
    ("insights", []),
]
FALLBACK = "insights"

SEGMENT_THRESHOLD = 0.15
SOFTMAX_SCALE = 10.0

# Label list for encoding the ``events.event_type`` column (``error`` is
# unknown and maps to the default id 0).
EVENT_LABELS = ["view", "click", "purchase", "signup"]

# Label list for the classifier-backed tier on the test tables: document
# languages placed on label ids of the 32-class layout (en calm, fr and es on
# ids counted as crisis, de on a negative id); other ids unused.
LANG_LABEL_POSITIONS = {"en": 0, "fr": 14, "de": 17, "es": 24}
LANG_LABELS = [next((k for k, v in LANG_LABEL_POSITIONS.items() if v == i), f"unused_{i}") for i in range(32)]

# Fillers for the test documents: a whole word, one with a blank inside, and one
# that also occurs inside longer words (where it must stay).
DOCUMENT_FILLERS = ["than", "in the", "er"]


def default_lexicon() -> dict:
    """The library's own severity lexicon."""
    from .. import defaults as D

    return D.TIER_KEYWORDS

#: Tokens a side of an LCS tile: small, so that the sessions here have several.
LCS_TILE = 512
