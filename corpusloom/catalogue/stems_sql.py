"""The stems of a table ``words(term)`` as SQL stages, for the twins of the stem queries.

Other than the library's expressions these mark each letter as a vowel or a consonant and
count the groups of marks.
"""

from __future__ import annotations

from corpusloom.functions import stems as st


def _marks(x: str) -> str:
    """``x`` with its vowels as 1, or ~ for a y that is one; what is left are consonants."""
    return f"regexp_replace(regexp_replace({x}, '[aeiou]', '1', 'g'), '([^1y]|^y)y', '\\1~', 'g')"


def _measure(x: str) -> str:
    return f"len(regexp_extract_all({_marks(x)}, '[1~]+[^1~]+'))"


def _has_vowel(x: str) -> str:
    return f"regexp_matches({_marks(x)}, '[1~]')"


def _closed(x: str) -> str:
    """Ends in consonant, vowel, consonant other than w, x, y."""
    return f"(regexp_matches({_marks(x)}, '[^1~][1~][^1~]$') AND right({x}, 1) NOT IN ('w', 'x', 'y'))"


def _rules(rules: dict[str, str], fits: str) -> str:
    """The longest suffix decides; ``fits`` is a condition on ``{}``, what stands before it."""
    whens = []
    for suffix in sorted(rules, key=lambda s: (-len(s), s)):
        stem = f"left(w, -{len(suffix)})"
        own = fits.replace("{}", stem)
        if suffix == "ion":
            own = f"{own} AND right({stem}, 1) IN ('s', 't')"
        whens.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {own} THEN {stem} || '{rules[suffix]}' ELSE w END")
    return "CASE " + "\n    ".join(whens) + " ELSE w END"


_DOUBLE = "(right(s, 1) = left(right(s, 2), 1) AND length(s) > 1 AND right(s, 1) NOT IN ('a','e','i','o','u','y','l','s','z'))"
_SOME = _measure("{}") + " > 0"

STAGES = f"""p0 AS (SELECT term, term AS w FROM words WHERE regexp_matches(term, '^[a-z][a-z][a-z]+$')),
p1 AS (SELECT term, {_rules(st.STEP_1A, "true")} AS w FROM p0),
p2 AS (SELECT term, w, CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') THEN left(w, -2)
    WHEN ends_with(w, 'ing') THEN left(w, -3) END AS s FROM p1),
p3 AS (SELECT term, CASE
    WHEN ends_with(w, 'eed') THEN CASE WHEN {_measure("left(w, -3)")} > 0 THEN left(w, -1) ELSE w END
    WHEN s IS NULL OR NOT {_has_vowel("s")} THEN w
    WHEN right(s, 2) IN ('at', 'bl', 'iz') THEN s || 'e'
    WHEN {_DOUBLE} THEN left(s, -1)
    WHEN {_measure("s")} = 1 AND {_closed("s")} THEN s || 'e'
    ELSE s END AS w FROM p2),
p4 AS (SELECT term, CASE WHEN right(w, 1) = 'y' AND {_has_vowel("left(w, -1)")} THEN left(w, -1) || 'i' ELSE w END AS w FROM p3),
p5 AS (SELECT term, {_rules(st.STEP_2, _SOME)} AS w FROM p4),
p6 AS (SELECT term, {_rules(st.STEP_3, _SOME)} AS w FROM p5),
p7 AS (SELECT term, {_rules(dict.fromkeys(st.STEP_4, ""), _measure("{}") + " > 1")} AS w FROM p6),
p8 AS (SELECT term, CASE WHEN right(w, 1) = 'e' AND ({_measure("left(w, -1)")} > 1
    OR {_measure("left(w, -1)")} = 1 AND NOT {_closed("left(w, -1)")}) THEN left(w, -1) ELSE w END AS w FROM p7),
p9 AS (SELECT term, CASE WHEN right(w, 2) = 'll' AND {_measure("w")} > 1 THEN left(w, -1) ELSE w END AS en FROM p8),
f1 AS (SELECT term, CASE WHEN right(term, 1) = 's' THEN left(term, -1) ELSE term END AS w FROM words),
f2 AS (SELECT term, CASE WHEN right(w, 1) = 'r' THEN left(w, -1) ELSE w END AS w FROM f1),
f3 AS (SELECT term, CASE WHEN right(w, 1) = 'e' THEN left(w, -1) ELSE w END AS w FROM f2),
f4 AS (SELECT term, CASE WHEN right(w, 1) = 'é' THEN left(w, -1) ELSE w END AS w FROM f3),
f5 AS (SELECT term, CASE
    WHEN length(term) < 6 THEN term
    WHEN right(term, 3) = 'aux' THEN left(term, -2) || 'l'
    WHEN right(term, 1) = 'x' THEN left(term, -1)
    WHEN length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) THEN left(w, -1) ELSE w END AS fr FROM f4),
stems AS (SELECT term, coalesce(p9.en, term) AS en, f5.fr FROM f5 LEFT JOIN p9 USING (term))"""
