"""Stemming by suffix rules in stages, as column expressions.

English words go through the five steps of Porter's algorithm (1980), French ones through
Savoy's minimal rules (1999). A stage is a table of suffixes with what replaces them; the
longest suffix that fits decides, and its condition looks at what stands before it: its
measure (the number of vowel-consonant groups), a vowel, or its last letters. Stages are
meant for the distinct words of a vocabulary, see ``words.stem_counts``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let

# The algorithm's letter classes. A y after a consonant is a vowel.
_C = "[^aeiou](?:[^aeiouy])*"
_V = "[aeiouy](?:[aeiou])*"
SOME = f"^(?:{_C})?{_V}{_C}"  # measure above 0
ONE = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"  # measure 1
MORE = f"^(?:{_C})?{_V}{_C}{_V}{_C}"  # measure above 1
VOWEL = f"^(?:{_C})?[aeiouy]"
DOUBLE = "(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"
SHORT_START = f"^(?:{_C})[aeiouy][^aeiouwxy]$"

# The suffixes of each step and what replaces them, with the two that the
# algorithm's author changed later (``bli``, ``logi``).
STEP_1A = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "logi": "log", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)


def _cut(word: Column, suffix: str) -> Column:
    return word.substr(F.lit(1), F.length(word) - len(suffix))


def by_suffix(word: Column, rules: dict[str, str], fits: Callable[[Column, str], Column] | None = None) -> Column:
    """``word`` with its longest suffix of ``rules`` replaced, where ``fits(stem, suffix)``;
    if that suffix does not fit, a shorter one is not tried."""
    chain = None
    for suffix in sorted(rules, key=lambda s: (-len(s), s)):
        stem = _cut(word, suffix)
        changed = F.concat(stem, F.lit(rules[suffix]))
        if fits is not None:
            changed = F.when(fits(stem, suffix), changed).otherwise(word)
        test = F.endswith(word, F.lit(suffix))
        chain = F.when(test, changed) if chain is None else chain.when(test, changed)
    return chain.otherwise(word)


def _measured(pattern: str) -> Callable[[Column, str], Column]:
    return lambda stem, suffix: stem.rlike(pattern)


def _step_1b(word: Column) -> Column:
    def mended(stem: Column) -> Column:
        return (
            F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e")))
            .when(stem.rlike(DOUBLE), stem.substr(F.lit(1), F.length(stem) - 1))
            .when(stem.rlike(SHORT_START), F.concat(stem, F.lit("e")))
            .otherwise(stem)
        )

    def cut(suffix: str) -> Column:
        stem = _cut(word, suffix)
        return F.when(stem.rlike(VOWEL), mended(stem)).otherwise(word)

    eed = F.when(_cut(word, "eed").rlike(SOME), _cut(word, "d")).otherwise(word)
    return (
        F.when(F.endswith(word, F.lit("eed")), eed)
        .when(F.endswith(word, F.lit("ed")), cut("ed"))
        .when(F.endswith(word, F.lit("ing")), cut("ing"))
        .otherwise(word)
    )


def _step_1c(word: Column) -> Column:
    return by_suffix(word, {"y": "i"}, _measured(VOWEL))


def _step_4(word: Column) -> Column:
    def fits(stem: Column, suffix: str) -> Column:
        long_enough = stem.rlike(MORE)
        return long_enough & stem.rlike("[st]$") if suffix == "ion" else long_enough

    return by_suffix(word, dict.fromkeys(STEP_4, ""), fits)


def _step_5(word: Column) -> Column:
    def last(w: Column) -> Column:
        return F.when(w.rlike("ll$") & _cut(w, "l").rlike(MORE), _cut(w, "l")).otherwise(w)

    def fits(stem: Column, suffix: str) -> Column:
        return stem.rlike(MORE) | (stem.rlike(ONE) & ~stem.rlike(SHORT_START))

    return let(by_suffix(word, {"e": ""}, fits), last)


def staged(word: Column, stages: Sequence[Callable[[Column], Column]]) -> Column:
    """One stage after the other; each result is computed once."""
    for stage in stages:
        word = let(word, stage)
    return word


def english(word: Column) -> Column:
    """Porter's stem of a lower-case word; words of one or two letters, and words with
    anything but ``a`` to ``z``, stay."""
    stages = [
        lambda w: by_suffix(w, STEP_1A),
        _step_1b,
        _step_1c,
        lambda w: by_suffix(w, STEP_2, _measured(SOME)),
        lambda w: by_suffix(w, STEP_3, _measured(SOME)),
        _step_4,
        _step_5,
    ]
    # a capital stands for the y that begins a word and is a consonant
    marked = F.regexp_replace(word, "^y", "Y")
    return F.when(word.rlike("^[a-z]{3,}$"), F.lower(staged(marked, stages))).otherwise(word)


def french(word: Column) -> Column:
    """Savoy's minimal stem: of words of six letters and more the plural ``x`` (``aux`` to
    ``al``), else the last ``s``, ``r``, ``e`` and ``é`` in this order, and one of two equal
    last letters."""
    stages = [
        lambda w: F.when(w.rlike("s$"), _cut(w, "s")).otherwise(w),
        lambda w: F.when(w.rlike("r$"), _cut(w, "r")).otherwise(w),
        lambda w: F.when(w.rlike("e$"), _cut(w, "e")).otherwise(w),
        lambda w: F.when(w.rlike("é$"), _cut(w, "é")).otherwise(w),
        lambda w: F.when(w.rlike(r"(.)\1$"), _cut(w, "x")).otherwise(w),
    ]
    plural = F.when(word.rlike("aux$"), F.concat(_cut(word, "ux"), F.lit("l"))).otherwise(_cut(word, "x"))
    return (
        F.when(F.length(word) < 6, word).when(F.endswith(word, F.lit("x")), plural).otherwise(staged(word, stages))
    )


def stem(word: Column, lang: Column) -> Column:
    """The stem by the rules of ``lang`` (``en``, ``fr``); other languages are left alone,
    null stays null."""
    return F.when(lang == "en", english(word)).when(lang == "fr", french(word)).otherwise(word)
