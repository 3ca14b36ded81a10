"""Suffix-stripping stems (Porter's published algorithm with its common extensions) of distinct tokens.

The rules are data; every step is one ``CASE`` chain over a token column, so that a table of
distinct tokens is stemmed in generated code, once a token instead of once an occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values of the published algorithm ----
# consonant and vowel runs; y is a vowel after a consonant (a first y is written Y)
CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
# the stem has at least one / two vowel-consonant groups, has a vowel, ends in a short syllable
ONE = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}"
TWO = f"{ONE}{VOWELS}{CONSONANTS}"
VOWEL = f"^(?:{CONSONANTS})?[aeiouy]"
SHORT = f"^(?:{CONSONANTS}[aeiouy][^aeiouwxyY]|[aeiou][^aeiou])$"
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning",
    "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# (suffix, replacement, condition on the rest, letters of the suffix that count as rest,
#  replacement where the condition fails: None leaves the token); the first suffix that fits decides
STEPS = [
    [("sses", "ss", None, "", None), ("ies", "ie", "^.$", "", "i"), ("ss", "ss", None, "", None), ("s", "", None, "", None)],
    # a cut -ed or -ing leaves a mark that the next step takes away
    [("ied", "ie", "^.$", "", "i"), ("eed", "ee", ONE, "", None), ("ed", "|", VOWEL, "", None), ("ing", "|", VOWEL, "", None)],
    [("at|", "ate", None, "", None), ("bl|", "ble", None, "", None), ("iz|", "ize", None, "", None),
     *[(c + c + "|", c, None, "", None) for c in "bcdfghjkmnpqrtvwx"], *[(c + c + "|", c + c, None, "", None) for c in "lsz"],
     ("|", "e", SHORT, "", "")],
    [("y", "i", "^.+[^aeiouy]$", "", None)],
    [("alli", "al", ONE, "", None)],
    [(a, b, ONE, "", None) for a, b in [
        ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
        ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
        ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"),
        ("biliti", "ble"), ("fulli", "ful")]] + [("logi", "log", ONE, "l", None)],
    [(a, b, ONE, "", None) for a, b in [
        ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]],
    [(a, "", TWO, "", None) for a in "al ance ence er ic able ible ant ement ment ent".split()]
    + [("sion", "s", TWO, "s", None), ("tion", "t", TWO, "t", None)]
    + [(a, "", TWO, "", None) for a in "ou ism ate iti ous ive ize".split()],
    [("e", "e|", SHORT, "", None)],
    [("e", "", ONE, "", None)],
    [("|", "", None, "", None)],
    [("ll", "l", TWO, "l", None)],
]
# ---- end of fixed values ----


def _step(word: Column, rules) -> Column:
    out = None
    for suffix, replacement, condition, kept, other in rules:
        rest = F.left(word, F.length(word) - len(suffix))
        to = F.concat(rest, F.lit(replacement))
        if condition is not None:
            failed = word if other is None else F.concat(rest, F.lit(other))
            to = F.when(F.concat(rest, F.lit(kept)).rlike(condition), to).otherwise(failed)
        fits = F.endswith(word, F.lit(suffix))
        out = F.when(fits, to) if out is None else out.when(fits, to)
    return out.otherwise(word)


def stem_table(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``token, stem`` of the distinct lower-case ``token`` values that are not null.

    Tokens of one or two characters are their own stems. A token is stemmed as it stands:
    characters other than a-z count as consonants.
    """
    t = tokens.select(F.col(token).alias("token")).where("token IS NOT NULL").distinct()
    t = t.withColumn("_w", F.regexp_replace("token", "^y", "Y"))
    for rules in STEPS:
        t = t.withColumn("_w", _step(F.col("_w"), rules))
    known = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    stem = F.coalesce(F.element_at(known, F.col("token")), F.when(F.length("token") <= 2, F.col("token")).otherwise(F.lower("_w")))
    return t.select("token", stem.alias("stem"))
