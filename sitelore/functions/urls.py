"""URL expressions: parse, normalise, resolve and classify, all inside Spark SQL."""

from __future__ import annotations

from sitelore.functions import vocab as V
from sitelore.functions.let import any_of, contains_any, let, lit, one_of

URL_RE = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
SCHEME_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
TAIL_RE = r"(?s)\??(?:#.*)?\z"
HREF_RE = r"""(?is)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def _part(url: str, number: int) -> str:
    return f"regexp_extract({url}, {lit(URL_RE)}, {number})"


def scheme(url: str) -> str:
    return f"lower({_part(url, 1)})"


def netloc(url: str) -> str:
    """Authority as written: port and case are kept."""
    return _part(url, 2)


def path(url: str) -> str:
    """Path without the ``;params`` of its last segment."""
    return f"regexp_replace({_part(url, 3)}, ';[^/]*$', '')"


def query(url: str) -> str:
    return _part(url, 4)


def fragment(url: str) -> str:
    return _part(url, 5)


def origin(url: str) -> str:
    return f"concat({scheme(url)}, '://', {netloc(url)})"


def normalize(url: str) -> str:
    """Drop the fragment and an empty query, lower-case the scheme; keep everything else."""
    bare = f"regexp_replace({url}, {lit(TAIL_RE)}, '')"
    head = f"lower(regexp_extract(bare, {lit(SCHEME_RE)}, 0))"
    return let("bare", bare, f"concat({head}, regexp_replace(bare, {lit(SCHEME_RE)}, ''))")


def _remove_dots(p: str) -> str:
    """Apply ``.`` and ``..`` segments; a path that ends in one keeps a trailing slash."""
    walked = f"""aggregate(split({p}, '/'), CAST(array() AS array<string>), (done, seg) -> CASE
        WHEN seg = '..' THEN slice(done, 1, greatest(size(done) - 1, 0))
        WHEN seg = '.' THEN done ELSE concat(done, array(seg)) END)"""
    tail = f"CASE WHEN {p} RLIKE {lit(r'(^|/)[.][.]?$')} THEN '/' ELSE '' END"
    clean = f"concat('/', regexp_replace(concat(array_join({walked}, '/'), {tail}), '^/+', ''))"
    return f"CASE WHEN {p} RLIKE {lit(r'(^|/)[.][.]?(/|$)')} THEN {clean} ELSE {p} END"


def _merge_path(base_path: str, ref_path: str) -> str:
    """Path of a reference seen from the folder of the base; empty inner segments are dropped."""
    folder = f"regexp_replace({base_path}, '[^/]*$', '')"
    merged = f"regexp_replace(concat('/', {folder}, {ref_path}), '/+', '/')"
    whole = f"CASE WHEN startswith({ref_path}, '/') THEN {ref_path} ELSE {merged} END"
    return let("whole_path", whole, _remove_dots("whole_path"))


def resolve(base: str, href: str) -> str:
    """Absolute form of ``href`` found on the page ``base`` (fragment kept)."""
    ref = let("h", href, f"""named_struct('head', h, 'scheme', {scheme('h')}, 'host', {netloc('h')},
        'path', {_part('h', 3)}, 'tail', regexp_extract(h, '(?s)^[^?#]*(.*)$', 1))""")
    page = let("b", base, f"""named_struct('url', b, 'scheme', {scheme('b')}, 'host', {netloc('b')},
        'path', {_part('b', 3)}, 'query', regexp_extract(b, {lit(r'(?s)^[^?#]*([?][^#]*)?')}, 1))""")
    start = "concat(page.scheme, '://', page.host)"
    rules = f"""CASE WHEN ref.head = '' THEN page.url
        WHEN ref.scheme <> '' AND (ref.scheme <> page.scheme OR ref.host <> '') THEN ref.head
        WHEN ref.host <> '' THEN concat(page.scheme, ':', ref.head)
        WHEN ref.path <> '' THEN concat({start}, {_merge_path('page.path', 'ref.path')}, ref.tail)
        WHEN startswith(ref.tail, '?') THEN concat({start}, page.path, ref.tail)
        ELSE concat({start}, page.path, page.query, ref.tail) END"""
    return let("ref", ref, let("page", page, rules))


def unquote_attribute(value: str) -> str:
    return f"""regexp_replace({value}, {lit("^[\"']|[\"']$")}, '')"""


def is_product(path_lower: str) -> str:
    return contains_any(path_lower, V.PRODUCT_PATHS)


def drop_reason(site: str, norm: str) -> str:
    """First matching reason in fixed order; ``kept`` when none applies."""
    low = f"named_struct('path', lower({path('u')}), 'query', lower({query('u')}))"
    asset = "(?:" + any_of(V.ASSET_SUFFIXES) + ")$"
    rules = f"""CASE WHEN u IS NULL THEN 'invalid'
        WHEN {scheme('u')} NOT IN ('http', 'https') THEN 'non_http'
        WHEN {netloc('u')} <> {site} THEN 'offsite'
        WHEN low.path RLIKE {lit(asset)} THEN 'asset'
        WHEN {contains_any('low.path', V.TRANSACTIONAL_PATHS)} THEN 'transactional'
        WHEN {contains_any('low.path', V.ARCHIVE_PATHS)} THEN 'archive'
        WHEN {contains_any('low.query', V.FACET_QUERIES)} THEN 'faceted'
        WHEN {is_product('low.path')} THEN 'product'
        ELSE 'kept' END"""
    return let("u", norm, let("low", low, rules))


def knowledge_tier(url: str) -> str:
    """skip / high / medium / low over the whole lower-cased URL, host included."""
    return let("low", f"lower({url})", f"""CASE WHEN {contains_any('low', V.TIER_SKIP)} THEN 'skip'
        WHEN {contains_any('low', V.TIER_HIGH)} THEN 'high'
        WHEN {contains_any('low', V.TIER_MEDIUM)} THEN 'medium'
        WHEN {contains_any('low', V.TIER_LOW)} THEN 'low' ELSE 'medium' END""")


def is_root(url: str) -> str:
    return f"({path(url)} IN {one_of(['', '/'])})"
