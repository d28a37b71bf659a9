"""Language expressions: script shares, stop-word votes and names."""

from __future__ import annotations

from sitelore.functions import vocab as V
from sitelore.functions.let import let, lit, mapping, one_of
from sitelore.functions.text import cap


def script_language(text: str, max_chars: int | None = None) -> str:
    """``fa`` or ``ar`` when enough letters are of Arabic script, else NULL."""
    arabic = f"regexp_count(sample, {lit(f'[{V.ARABIC_RANGES}]')})"
    latin = "length(regexp_replace(sample, '[^A-Za-z]+', ''))"  # only where needed
    share = f"n >= {V.SCRIPT_MIN_SHARE}D * (n + {latin})"
    persian = f"CASE WHEN sample RLIKE {lit(f'[{V.PERSIAN_LETTERS}]')} THEN 'fa' ELSE 'ar' END"
    decide = f"CASE WHEN n >= {V.SCRIPT_MIN_LETTERS} THEN CASE WHEN {share} THEN {persian} END END"
    return let("sample", cap(text, max_chars), let("n", arabic, decide))


def stopword_language(text: str, max_chars: int | None = None) -> str:
    """Language whose stop words occur most; ties by code; default when none occurs.

    The words of a text are looked up once in the set of all stop words; the few that are left
    are then counted per language.
    """
    listed = sorted({w for words in V.STOPWORDS.values() for w in words})
    words = rf"split(lower(coalesce({cap(text, max_chars)}, '')), '[^\\p{{L}}]+')"
    hits = f"filter({words}, w -> w IN {one_of(listed)})"
    vote = lambda code: (
        f"named_struct('n', size(filter(hits, w -> w IN {one_of(V.STOPWORDS[code])})), 'code', {lit(code)})"
    )
    # codes go in descending order, so a later equal vote has the smaller code
    votes = "array(" + ", ".join(vote(c) for c in sorted(V.STOPWORDS, reverse=True)) + ")"
    start = f"named_struct('n', 1, 'code', {lit(V.DEFAULT_LANGUAGE)})"
    best = f"aggregate({votes}, {start}, (top, v) -> CASE WHEN v.n >= top.n THEN v ELSE top END).code"
    return let("hits", hits, best)


def detect_language(text: str) -> str:
    return f"coalesce({script_language(text)}, {stopword_language(text)})"


def language_name(code: str) -> str:
    return f"""coalesce(try_element_at({mapping(V.LANGUAGE_NAMES)}, lower(coalesce({code}, ''))),
        CASE WHEN coalesce({code}, '') = '' THEN {lit(V.UNKNOWN_LANGUAGE)} ELSE {code} END)"""
