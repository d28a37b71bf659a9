"""Contact expressions."""

from __future__ import annotations

from sitelore.functions import vocab as V
from sitelore.functions.let import let, lit
from sitelore.functions.text import strip

PHONE_RUN_RE = r"[\p{Nd}\s\p{Z}()+-]{%d,}"
NONE = "CAST(array() AS array<string>)"


def emails(text: str) -> str:
    """Distinct e-mail addresses of a text."""
    found = f"array_distinct(regexp_extract_all(t, {lit(V.EMAIL_RE)}, 0))"
    return let("t", text, f"CASE WHEN contains(t, '@') THEN {found} ELSE {NONE} END")


def phones(text: str) -> str:
    """Distinct phone-like runs whose digit count is plausible."""
    low, high = V.PHONE_DIGITS
    # a match lies inside a run of digits, blanks and phone signs: look there only
    runs = f"regexp_extract_all({text}, {lit(PHONE_RUN_RE % low)}, 0)"
    matches = f"flatten(transform({runs}, run -> regexp_extract_all(run, {lit(V.PHONE_RE)}, 0)))"
    found = f"transform({matches}, m -> {strip('m')})"
    digits = rf"length(regexp_replace(m, '\\P{{Nd}}', ''))"
    return f"array_distinct(filter({found}, m -> {digits} BETWEEN {low} AND {high}))"


def context(emails_text: str, phones_text: str) -> str:
    """Contact block for the contact section; NULL when there is nothing to show."""
    none = lambda x: f"coalesce(nullif({x}, ''), 'none')"
    block = f"concat('Emails: ', {none(emails_text)}, '\\nPhones: ', {none(phones_text)})"
    return f"CASE WHEN concat(coalesce({emails_text}, ''), coalesce({phones_text}, '')) <> '' THEN {block} END"
