"""Page elements and locators.

Everything happens inside the row of a page: the tags of a page form one array, each selector
filters it and keeps its first matches, so no shuffle is needed to rank within a page.  The text of
an element is that of all nodes inside it: a range of the array of texts, from its tag to its end.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from sitelore.functions import text as T, vocab as V
from sitelore.functions.let import contains_any, let, lit, one_of
from sitelore.functions.scale import salted_join
from sitelore.functions.urls import unquote_attribute

NAME_RE = "^</?([a-zA-Z][a-zA-Z0-9-]*)"
#: A tag, or a declaration, and the text up to the next one; a lone ``<`` is text.
TAG_AND_TEXT_RE = T.TAG_RE + "(?:[^<]++|<(?![/!?A-Za-z]))*+"
ATTRIBUTES = ("id", "class", "href", *V.ATTRIBUTE_VALUES)
PER_SELECTOR, PER_ELEMENT = 5, 5  # options of the inventory and the locators, off by default


@F.pandas_udf(ArrayType(IntegerType()))
def tag_ends(signs: pd.Series) -> pd.Series:
    """Where the element of each tag ends, as a place in the array of tags; 0 for what opens nothing.

    A sign is the name of an opening tag, ``/name`` of a closing one, or empty for tags without
    content.  A closing tag ends the last open element of its name and all that were opened inside it;
    without one it is ignored.  What is left open ends with the page.  Each tag is pushed and popped
    once, so a page takes time in proportion to its tags.
    """

    def ends(row):
        if row is None:
            return None
        out, stack, open_ = [0] * len(row), [], {}
        for i, sign in enumerate(row):
            if not sign:
                continue
            if sign[0] != "/":
                stack.append((sign, i))
                open_[sign] = open_.get(sign, 0) + 1
            elif open_.get(sign[1:]):
                name = None
                while name != sign[1:]:
                    name, start = stack.pop()
                    open_[name] -= 1
                    out[start] = i
        for _, start in stack:
            out[start] = len(row)
        return out

    return signs.map(ends)


def _attribute(tag: str, name: str) -> str:
    """Attribute as written in the tag, with its quotes if any; '' when absent."""
    pattern = rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+)"""
    return f"regexp_extract({tag}, {lit(pattern)}, 1)"


def page_tags(pages: DataFrame, html: str = "html") -> DataFrame:
    """The other columns, ``tags`` (opening and closing ones), ``texts`` (after each tag) and ``ends``.

    Only the names of the tags go to Python and only the places of the ends come back.
    """
    keep = [c for c in pages.columns if c != html]
    name = f"lower(regexp_extract(tag, {lit(NAME_RE)}, 1))"
    empty = f"{name} IN {one_of(V.EMPTY_TAGS)} OR endswith(tag, '/>')"
    sign = f"""CASE WHEN startswith(tag, '</') THEN concat('/', {name}) WHEN {empty} THEN '' ELSE {name} END"""
    cut = pages.select(
        *keep, F.expr(f"regexp_extract_all({T.without_scripts(html)}, {lit(TAG_AND_TEXT_RE)}, 0)").alias("found")
    ).select(*keep, "found", F.expr(f"transform(found, raw -> regexp_extract(raw, {lit('^' + T.TAG_RE)}, 0))").alias("tags"))
    return cut.select(
        *keep, "tags", F.expr(f"transform(found, (raw, i) -> {T.unescape('substring(raw, length(tags[i]) + 1)')})").alias("texts"),
        tag_ends(F.expr(f"transform(tags, tag -> {sign})")).alias("ends"),
    )


def _element(opening: str, number: str) -> str:
    value = lambda name: T.unescape(unquote_attribute(_attribute("opening", name)))
    attributes = ", ".join(f"'{a}', {value(a)}" for a in ATTRIBUTES)
    return let("opening", opening, f"""named_struct(
        'no', CAST({number} + 1 AS BIGINT),
        'tag', lower(regexp_extract(opening, {lit(NAME_RE)}, 1)),
        'has_href', {_attribute('opening', 'href')} <> '',
        {attributes})""")


def _elements() -> str:
    """Array of the elements of ``tags`` in order: number, tag, attributes, place in the array of tags."""
    places = "filter(sequence(0, size(tags) - 1), i -> tags[i] RLIKE '^<[a-zA-Z]')"
    rows = f"transform(places, (at, n) -> named_struct('at', at, 'of', {_element('tags[at]', 'n')}))"
    return f"CASE WHEN size(tags) > 0 THEN {let('places', places, rows)} ELSE array() END"


def _inner(texts: str) -> str:
    """Texts from an opening tag up to its end; of a tag without content none."""
    return f"array_join(slice({texts}, e.at + 1, greatest(ends[e.at] - e.at, 0)), '')"


def _matches(tag, attribute, test, value) -> str:
    """SQL test of one selector on element ``e``."""
    actual = f"e.of.`{attribute}`"
    tests = [f"e.of.tag = {lit(tag)}"] if tag else []
    tests += {
        None: [],
        "present": ["e.of.has_href"],
        "equals": [f"{actual} = {lit(value or '')}"],
        "contains": [f"contains({actual}, {lit(value or '')})"],
        "icontains": [f"contains(lower({actual}), {lit(value or '')})"],
        "text": [f"contains({_inner('texts')}, {lit(value or '')})"],
    }[test]
    return " AND ".join(tests)


def _first(array: str, limit: int | None) -> str:
    return array if limit is None else f"slice({array}, 1, {limit})"


def inventory_array(limit: int | None = None) -> str:
    """Array of (category, selector, selector_no, element): the matches of each selector.

    The text of an element is put together for those that a selector took: its texts, blanks around each
    cut off, one after another.
    """
    fields = ", ".join(f"'{n}', e.of.`{n}`" for n in ("no", "tag", "has_href", *ATTRIBUTES))
    element = f"named_struct('text', {_inner('stripped')}, {fields})"
    groups = ", ".join(
        f"""transform({_first(f"filter(els, e -> {_matches(*rule)})", limit)}, e -> named_struct(
            'category', {lit(category)}, 'selector', {lit(selector)},
            'selector_no', CAST({number} AS BIGINT), 'element', {element}))"""
        for number, (category, selector, *rule) in enumerate(V.SELECTORS)
    )
    stripped = f"transform(texts, x -> {T.strip('x')})"
    return let("els", _elements(), let("stripped", stripped, f"flatten(array({groups}))"))


def element_inventory(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """The elements that each selector takes, with their texts and attributes."""
    keep = [c for c in pages.columns if c != "html"]
    return page_tags(pages).select(*keep, F.expr(f"inline({inventory_array(limit)})"))


def _digits(x: str) -> str:
    return f"regexp_count({x}, {lit(r'\p{Nd}')})"


def _locator(test: str, value: str, close: str = "']") -> str:
    return f"concat('//', e.tag, {lit(test)}, {value}, {lit(close)})"


def _by_id() -> str:
    dynamic = f"""(length(e.id) > 10 AND {_digits('e.id')} > 0) OR contains(e.id, '__')
        OR startswith(e.id, 'id_') OR {_digits('e.id')} > 3
        OR {contains_any('lower(e.id)', V.DYNAMIC_ID_WORDS)}"""
    stable = f"e.id IN {one_of(V.STABLE_IDS)} OR (length(e.id) < 8 AND {_digits('e.id')} = 0)"
    personal = contains_any("lower(e.id)", V.PERSONAL_ID_WORDS)
    return f"""CASE WHEN e.id <> '' AND NOT ({dynamic}) AND ({stable}) AND NOT {personal}
        THEN {_locator("[@id='", "e.id")} END"""


def _by_text() -> list[str]:
    generic = f"""length(e.text) BETWEEN 2 AND 29 AND {_digits('e.text')} = 0
        AND NOT contains(e.text, '@') AND NOT {contains_any('lower(e.text)', V.PERSONAL_TEXT_WORDS)}
        AND {contains_any('lower(e.text)', V.ACTION_WORDS)}"""
    quoted = f"""replace(e.text, {lit("'")}, {lit(chr(92) + "'")})"""
    return [
        f"""CASE WHEN {generic} THEN {_locator("[contains(text(), '", quoted, "')]")} END""",
        f"""CASE WHEN {generic} THEN {_locator("[text()='", quoted)} END""",
    ]


def _by_attribute(name: str, allowed) -> str:
    value = f"e.`{name}`"
    usable = f"{value} <> '' AND length({value}) < 50"
    if allowed:
        usable += f" AND {value} IN {one_of(allowed)}"
    plain = f"""WHEN {_digits(value)} = 0 AND NOT contains({value}, '@')
        THEN {_locator(f"[@{name}='", value)}"""
    picture = ""
    if name == "alt":
        whole = _locator("[contains(@alt, 'profile picture')]", "''", "")
        picture = f"WHEN contains(lower({value}), 'profile picture') THEN {whole}"
    return f"CASE WHEN NOT ({usable}) THEN NULL {picture} {plain} END"


def _by_class() -> str:
    fits = f"""filter(split(e.class, {lit(chr(92) + 's+')}), c ->
        {contains_any('lower(c)', V.CLASS_WORDS)} AND length(c) < 25)"""
    return f"""transform(slice({fits}, 1, 1), c -> {_locator("[contains(@class, '", "c", "')]")})"""


def locators(element: str, limit: int | None = None) -> str:
    """Distinct locators of an element; the class is used when nothing else is."""
    personal = contains_any("lower(e.href)", V.PERSONAL_HREFS)
    by_href = f"""CASE WHEN e.href <> '' AND NOT {personal} THEN {_locator("[@href='", "e.href")} END"""
    tests = [_by_id(), *_by_text(), *[_by_attribute(a, v) for a, v in V.ATTRIBUTE_VALUES.items()], by_href]
    found = let(
        "found", f"array_compact(array({', '.join(tests)}))",
        f"CASE WHEN size(found) > 0 THEN found ELSE {_by_class()} END",
    )
    return _first(f"array_distinct({let('e', element, found)})", limit)


def element_xpaths(pages: DataFrame) -> DataFrame:
    rows = element_inventory(pages)
    keep = [c for c in rows.columns if c != "element"]
    return rows.select(
        *keep, F.col("element.no").alias("element_no"),
        F.posexplode(F.expr(locators("element"))).alias("xpath_no", "xpath"),
    ).withColumn("xpath_no", (F.col("xpath_no") + 1).cast("bigint"))


def page_xpaths(pages: DataFrame) -> DataFrame:
    """Distinct locators per (page, category) with the place of their first occurrence."""
    keys = [c for c in pages.columns if c != "html"] + ["category", "xpath"]
    first = F.min(F.struct("selector_no", "element_no", "xpath_no")).alias("first")
    return element_xpaths(pages).groupBy(*keys).agg(first).select(
        *keys, F.col("first.selector_no").alias("selector_no"),
        F.col("first.element_no").alias("element_no"),
    )


def selector_coverage(pages: DataFrame) -> DataFrame:
    """On how many pages of its site each locator occurs, and the share of the site's pages."""
    seen = element_xpaths(pages).select("site", "category", "xpath", "page_id").distinct()
    counts = seen.groupBy("site", "category", "xpath").agg(F.count(F.lit(1)).alias("n_pages"))
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("site_pages"))
    return salted_join(counts, totals, ["site"]).withColumn(
        "share", F.col("n_pages") / F.col("site_pages")
    )
