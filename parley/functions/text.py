"""Column -> Column text functions. All native (JVM, whole-stage codegen)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import defaults as D


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filler_pattern(fillers=None) -> str:
    return r"(?i)\b(" + "|".join(fillers or D.FILLERS) + r")\b"


def remove_fillers(c, fillers=None) -> Column:
    return F.regexp_replace(_col(c), filler_pattern(fillers), "")


def repair_false_starts(c) -> Column:
    """``wor- worried`` -> ``worried``-style repair (word, hyphen, blanks, same word)."""
    return F.regexp_replace(_col(c), r"(?i)\b(\w+)-\s+\1", "$1")


def normalize_text(c, fillers=None, mode: str = "strict") -> Column:
    """Normalise an utterance.

    ``strict`` keeps the original step order: lower/strip, non-ASCII runs to a
    blank, characters outside word/space/``.,!?'`` to a blank, fillers removed,
    false starts repaired (a no-op by then, since hyphens are gone), blanks
    collapsed, stripped. ``repaired`` maps curly apostrophes to ``'`` and runs
    the false-start repair before hyphens are removed. Null is treated as
    empty text.
    """
    x = F.lower(F.coalesce(_col(c), F.lit("")))
    x = F.trim(x)
    if mode == "repaired":
        x = F.regexp_replace(x, "[‘’]", "'")
        x = repair_false_starts(x)
    x = F.regexp_replace(x, r"[^\x00-\x7F]+", " ")
    x = F.regexp_replace(x, r"[^\w\s.,!?']", " ")
    x = remove_fillers(x, fillers)
    if mode == "strict":
        x = repair_false_starts(x)
    x = F.regexp_replace(x, r"\s+", " ")
    return F.trim(x)


def assign_role(c, keywords=None) -> Column:
    """``counselor`` if the lower-cased speaker contains any keyword, else ``client``."""
    s = F.lower(F.coalesce(_col(c), F.lit("")))
    hit = reduce(lambda a, b: a | b, [s.contains(k) for k in (keywords or D.COUNSELOR_KEYWORDS)])
    return F.when(hit, F.lit("counselor")).otherwise(F.lit("client"))


SENTENCE_BREAK = r"(?<=[.!?])\s+"


def _abbrev_alternation(abbreviations) -> str:
    import re

    return "|".join(re.escape(a.lower().rstrip(".")) for a in abbreviations)


def sentence_break(abbreviations=None) -> str:
    """Break pattern: blanks after ``.``/``!``/``?``, except after one of the
    ``abbreviations`` (e.g. ``["dr.", "e.g."]``, case-insensitive)."""
    if not abbreviations:
        return SENTENCE_BREAK
    return r"(?<=[.!?])(?<!(?i:\b(?:" + _abbrev_alternation(abbreviations) + r")\.))\s+"


def ends_sentence(c, abbreviations=None) -> Column:
    """True when the text ends with ``.``/``!``/``?`` that is not an abbreviation's dot."""
    col = _col(c)
    ends = col.rlike(r"[.!?]$")
    if abbreviations:
        ends = ends & ~col.rlike(r"(?i)\b(?:" + _abbrev_alternation(abbreviations) + r")\.$")
    return ends


def split_sentences(c, abbreviations=None) -> Column:
    """Sentences of a text: split after ``.``/``!``/``?`` followed by blanks
    (not after the given abbreviations); blanks dropped."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), sentence_break(abbreviations))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def lexicon_tier(c, lexicon=None) -> Column:
    """Highest tier (5..2) having a phrase contained in the lower-cased text; else 1."""
    lex = lexicon or D.TIER_KEYWORDS
    t = F.lower(F.coalesce(_col(c), F.lit("")))
    expr = None
    for tier in sorted(lex, reverse=True):
        phrases = lex[tier]
        if not phrases:
            continue
        cond = reduce(lambda a, b: a | b, [t.contains(p) for p in phrases])
        expr = F.when(cond, F.lit(tier)) if expr is None else expr.when(cond, F.lit(tier))
    return F.lit(1) if expr is None else expr.otherwise(F.lit(1))


def tier_label(c, labels=None) -> Column:
    """Tier number -> label (null for unknown tiers)."""
    lab = labels or D.TIER_LABELS
    m = F.create_map(*[x for k in sorted(lab) for x in (F.lit(k), F.lit(lab[k]))])
    return F.element_at(m, _col(c).cast("int"))


def encode_label(c, labels=None, default: int = 0) -> Column:
    """Lower-cased label -> its index in ``labels``; unknown or null -> ``default``."""
    arr = F.array(*[F.lit(x) for x in (labels or D.EMOTION_LABELS)])
    pos = F.array_position(arr, F.lower(_col(c)))
    return F.when(pos > 0, (pos - 1).cast("int")).otherwise(F.lit(default))


def section_of(c, rules=None) -> Column:
    """Name of the first section (in rule order) with a pattern found in the text; null if none."""
    expr = None
    for name, patterns in (rules or D.SECTION_PATTERNS):
        if not patterns:
            continue
        cond = reduce(lambda a, b: a | b, [_col(c).rlike("(?i)" + p) for p in patterns])
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return F.lit(None).cast("string") if expr is None else expr


def word_tokens(c, pattern: str = r"\b\w\w+\b") -> Column:
    """Vectoriser tokens (two or more word characters) of a text."""
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(pattern), 0)


def overlap_tokens(c) -> Column:
    """Overlap-metric tokens: lower case, runs outside ``[a-z0-9]`` are separators."""
    x = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9]+", " ")
    return F.filter(F.split(F.trim(x), " "), lambda s: s != "")


def graph_words(c) -> Column:
    """Words of a sentence for the sentence graph: lower case, starting with a
    letter, made of letters, apostrophes and hyphens."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"[\w'-]+"), 0)
    return F.filter(toks, lambda s: s.rlike(r"^[a-z][a-z'-]*$"))
