"""Streaming use of the row-wise operators.

The original program has no streams. Normalisation, role assignment, sentence
splitting and per-utterance lexicon tiers are row-wise, so they apply
unchanged to a streaming DataFrame. Session-level operators need a complete
session and are batch operators.
"""

from .rowwise import preprocess_stream  # noqa: F401
