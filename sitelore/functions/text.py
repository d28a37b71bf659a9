"""HTML-to-text, token and paragraph expressions (no parser, no Python per row)."""

from __future__ import annotations

from html.entities import html5, name2codepoint

from sitelore.functions.let import let, lit, mapping

# Blanks as Python's strip() sees them; \s and plain trim miss no-break and other Unicode spaces.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
SEP = "\u0001"
# The entities of HTML 4, and those names of HTML that browsers read without the semicolon.
NAMED_ENTITIES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
BARE_ENTITIES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
WINDOWS_1252 = {str(c): sign for c in range(0x80, 0xA0) if (sign := bytes([c]).decode("cp1252", "ignore"))}
ATTRIBUTES_RE = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+"""  # quoted values may hold >
TAG_RE = rf"<[/!?A-Za-z]{ATTRIBUTES_RE}>"
BLOCK_TAG_RE = rf"(?i)</?(?:p|li|td|h[1-6]|pre|blockquote)\b{ATTRIBUTES_RE}>"
GAP = "<br>"  # texts on both sides of a removed element stay two texts
BODY_RE = r"(?i)<body\b"
ANCHOR_RE = rf"(?is)<a\b{ATTRIBUTES_RE}>(.*?)</a\s*>"
TITLE_RE = rf"(?is)<title\b{ATTRIBUTES_RE}>([^<]*)</title\s*>"
RUN = 512  # signs of one run, whose depths are gathered before those of the next
BOILERPLATE = ("nav", "footer", "header", "noscript", "svg", "form", "iframe")


def strip(x: str) -> str:
    return f"trim(BOTH {lit(BLANKS)} FROM {x})"


def is_blank(x: str) -> str:
    return f"(coalesce({strip(x)}, '') = '')"


def cap(x: str, max_chars: int | None) -> str:
    """Optional character cap; None keeps the whole text."""
    return x if max_chars is None else f"substring({x}, 1, {max_chars})"


def replace_all(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)})"


def _number(digits: str) -> str:
    """Character of a numeric reference as browsers read it; NULL for far too many digits."""
    return let("point", f"CAST({digits} AS BIGINT)", f"""CASE
        WHEN point BETWEEN 128 AND 159 THEN coalesce(try_element_at({mapping(WINDOWS_1252)}, CAST(point AS STRING)), decode(unhex(lpad(hex(point), 8, '0')), 'UTF-32'))
        WHEN point = 0 OR point BETWEEN 55296 AND 57343 OR point > 1114111 THEN decode(unhex('0000FFFD'), 'UTF-32')
        WHEN point = 13 THEN chr(13)
        WHEN point BETWEEN 1 AND 8 OR point IN (11, 127) OR point BETWEEN 14 AND 31 OR point BETWEEN 64976 AND 65007 OR point % 65536 >= 65534 THEN ''
        ELSE decode(unhex(lpad(hex(point), 8, '0')), 'UTF-32') END""")


def unescape(x: str) -> str:
    """Decode HTML entities from left to right, each once: a text is cut at ``&``, each piece read by itself."""
    bare = f"^({'|'.join(BARE_ENTITIES)})"
    piece = f"""CASE
        WHEN p RLIKE '^#[xX][0-9a-fA-F]' THEN concat({_number("conv(right(concat('0', regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1)), 15), 16, 10)")},
          regexp_replace(p, '^#[xX][0-9a-fA-F]+;?', ''))
        WHEN p RLIKE '^#[0-9]' THEN concat({_number("right(regexp_extract(p, '^#([0-9]+)', 1), 18)")}, regexp_replace(p, '^#[0-9]+;?', ''))
        ELSE coalesce(
          concat(try_element_at({mapping(NAMED_ENTITIES)}, regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1)), regexp_replace(p, '^[A-Za-z0-9]+;', '')),
          concat(try_element_at({mapping(NAMED_ENTITIES)}, regexp_extract(p, {lit(bare)}, 1)), regexp_replace(p, {lit(bare)}, '')),
          concat('&', p)) END"""
    decoded = f"array_join(transform(split(t, '&'), (p, i) -> CASE WHEN i = 0 THEN p ELSE {piece} END), '')"
    return let("t", x, f"CASE WHEN contains(t, '&') THEN {decoded} ELSE t END")


def _innermost_re(tags) -> str:
    """Elements without an element of their own kind inside; one leading ``<`` passes other text quickly."""
    inner = "|".join(rf"{t}\b{ATTRIBUTES_RE}>[^<]*+(?:<(?!/?{t}\b)[^<]*+)*+</{t}\s*+>" for t in tags)
    return rf"(?is)<(?:{inner})"


def _marks_re(tag: str) -> str:
    return rf"(?i)</?{tag}\b{ATTRIBUTES_RE}>"


def _signs(marks: str) -> str:
    """1 for each opening tag, -1 for each closing one."""
    return f"transform({marks}, mark -> CASE WHEN startswith(mark, '</') THEN -1 ELSE 1 END)"


def depths(signs: str) -> str:
    """Running sums that never fall below 0, one for each sign.

    An array that grows by one is copied each time, so the sums are gathered in runs of ``RUN`` and the
    runs afterwards: time is in proportion to the signs.
    """
    runs = f"transform(sequence(0, greatest(size({signs}) - 1, 0) DIV {RUN}), run -> slice({signs}, run * {RUN} + 1, {RUN}))"
    one = let("depth", "greatest(here.depth + sign, 0)", "named_struct('depth', depth, 'out', array_append(here.out, depth))")
    part = f"aggregate(signs_of, named_struct('depth', acc.depth, 'out', CAST(array() AS ARRAY<INT>)), (here, sign) -> {one})"
    step = let("part", part, "named_struct('depth', part.depth, 'out', array_append(acc.out, part.out))")
    start = "named_struct('depth', 0, 'out', CAST(array() AS ARRAY<ARRAY<INT>>))"
    return f"flatten(aggregate({runs}, {start}, (acc, signs_of) -> {step}).out)"


def _drop_nested(html: str, marks_re: str, by: str) -> str:
    """Without the elements of one kind, from the depths to the left and to the right of each piece between tags.

    A piece is inside an element if an opening tag to its left is still open and a closing one to its
    right still lacks its opening one.  Tags without a partner stay.
    """
    # dark[i]: whether the piece after tag i is inside; the piece before the first tag never is
    dark = "transform(fore, (depth, i) -> depth > 0 AND coalesce(get(aft, i + 1), 0) > 0)"
    kept = f"""array_join(transform(marks, (mark, i) -> concat(
        CASE WHEN NOT (dark[i] OR (i > 0 AND dark[greatest(i - 1, 0)])) THEN mark WHEN NOT dark[i] THEN {lit(by)} ELSE '' END,
        CASE WHEN dark[i] THEN '' ELSE pieces[i + 1] END)), '')"""
    body = let("dark", dark, f"concat(pieces[0], {kept})")
    body = let("fore", depths("signs"), let("back", "reverse(transform(signs, sign -> -sign))", let("aft", f"reverse({depths('back')})", body)))
    return let("marks", f"regexp_extract_all({html}, {marks_re}, 0)",
               let("pieces", f"split({html}, {marks_re}, -1)", let("signs", _signs("marks"), body)))


def drop_elements(html: str, tags, by: str = "") -> str:
    """Without the elements of these kinds, whatever their nesting, in time in proportion to the text.

    One pass takes the innermost ones, which is all on most pages.  Where closing tags are left, one kind
    after another is dropped by its depths.
    """
    ends = rf"(?i)</(?:{'|'.join(tags)})\s*>"
    kinds = ", ".join(f"named_struct('ends', {lit(rf'(?i)</{t}{chr(92)}s*>')}, 'marks', {lit(_marks_re(t))})" for t in tags)
    again = f"""aggregate(array({kinds}), rest, (left_over, kind) -> CASE WHEN left_over RLIKE kind.ends
        THEN {_drop_nested('left_over', 'kind.marks', by)} ELSE left_over END)"""
    return let("rest", replace_all(html, _innermost_re(tags), by), f"CASE WHEN rest RLIKE {lit(ends)} THEN {again} ELSE rest END")


def region(html: str, tag: str) -> str:
    """Inside of all elements of a kind, outermost ones once; pieces between the tags at a depth above 0."""
    inside = f"filter(slice(split({html}, {lit(_marks_re(tag))}, -1), 2, size(marks)), (piece, i) -> within[i] > 0)"
    found = let("signs", _signs("marks"), let("within", depths("signs"), f"array_join({inside}, {lit(GAP)})"))
    return let("marks", f"regexp_extract_all({html}, {lit(_marks_re(tag))}, 0)", f"CASE WHEN size(marks) = 0 THEN '' ELSE {found} END")


def without_scripts(html: str, by: str = "") -> str:
    """HTML without scripts, styles and comments; an unclosed script swallows the rest, as in a browser."""
    parts = "|".join(rf"{t}\b{ATTRIBUTES_RE}>.*?(?:</{t}\s*>|\z)" for t in ("script", "style"))
    return replace_all(html, rf"(?is)<(?:{parts}|!--.*?-->)", by)


def body(html: str) -> str:
    """Inside of ``<body>``; the whole text when there is none."""
    return replace_all(replace_all(html, rf"(?is)^.*?<body\b{ATTRIBUTES_RE}>"), r"(?is)</body\s*>.*$")


def text_nodes(html: str) -> str:
    """Text nodes trimmed, empty ones dropped, joined by newlines."""
    marked = unescape(replace_all(html, TAG_RE, SEP))
    pieces = f"transform(split({marked}, {lit(SEP)}), piece -> {strip('piece')})"
    return f"array_join(filter({pieces}, piece -> piece <> ''), '\\n')"


def plain_text(html: str, max_chars: int | None = None) -> str:
    """Body text without scripts and styles; empty when the page has no body."""
    text = f"CASE WHEN bare RLIKE {lit(BODY_RE)} THEN {text_nodes(body('bare'))} ELSE '' END"
    return cap(let("bare", without_scripts(html, GAP), text), max_chars)


def _own_region(html: str) -> str:
    return drop_elements(body(without_scripts(html, GAP)), BOILERPLATE, GAP)


def _region_text(region: str) -> str:
    squeezed = replace_all("region_text", r"\n{3,}", "\n\n")
    some = "contains(region_text, '\\n\\n\\n')"
    return let(
        "region_text", text_nodes(region), f"CASE WHEN {some} THEN {squeezed} ELSE region_text END"
    )


def clean_text(html: str, max_chars: int | None = None) -> str:
    """Body text without scripts, navigation, header, footer, forms and frames."""
    return cap(_region_text(_own_region(html)), max_chars)


def _mostly_text(block: str) -> str:
    """Block with text of which less than half is link text."""
    anchors = f"regexp_extract_all({block}, {lit(ANCHOR_RE)}, 1)"
    links = replace_all(f"array_join({anchors}, '')", TAG_RE)
    return let(
        "block_text", replace_all(block, TAG_RE),
        f"NOT {is_blank('block_text')} AND 2 * length({links}) < length(block_text)",
    )


def main_content(html: str, max_chars: int | None = None) -> str:
    """Main region, else articles, else text blocks that are not mostly links, else clean text."""
    kept = f"filter(split(page, {lit(BLOCK_TAG_RE)}), block -> {_mostly_text('block')})"
    blocks = text_nodes(f"array_join({kept}, {lit(GAP)})")
    # one beside the other, not one inside the other: each level of bindings costs the analyzer a pass
    long = lambda x: let("some", x, "CASE WHEN length(some) > 40 THEN some END")
    regions = ", ".join(long(text_nodes(region("page", tag))) for tag in ("main", "article"))
    return cap(let("page", _own_region(html), f"coalesce({regions}, {long(blocks)}, {_region_text('page')})"), max_chars)


def strip_noise_html(html: str, max_chars: int | None = None) -> str:
    """HTML without nine noise tag kinds; the other markup stays."""
    out = drop_elements(drop_elements(html, ("script", "style")), ("nav", "footer", "header", "noscript", "svg"))
    return cap(replace_all(out, rf"(?i)<(?:meta|link)\b{ATTRIBUTES_RE}>"), max_chars)


def page_title(html: str) -> str:
    """``<title>`` text; ``N/A`` when missing, empty or holding child tags."""
    raw = f"regexp_extract({html}, {lit(TITLE_RE)}, 1)"
    return let("raw", raw, f"CASE WHEN raw <> '' THEN {strip(unescape('raw'))} ELSE 'N/A' END")


def tokens(x: str) -> str:
    """Declared token measure: a quarter of the characters, at least 1, 0 for no text."""
    return f"CAST(CASE WHEN coalesce(length({x}), 0) = 0 THEN 0 ELSE greatest(1, length({x}) DIV 4) END AS BIGINT)"


def paragraphs(x: str) -> str:
    return f"filter(transform(split({x}, '\\n'), line -> {strip('line')}), line -> line <> '')"


def paragraph_key(x: str) -> str:
    """Lower case, blanks squeezed; single plain blanks are passed over."""
    uneven = f"[{WS}&&[^ ]][{WS}]*| [{WS}]+"
    return f"lower({replace_all(x, uneven, ' ')})"


def leading_paragraphs(x: str, max_tokens: int) -> str:
    """Leading paragraphs within a token limit; a too long first one is cut to fit."""
    # once a paragraph does not fit, `used` is above the limit and no later one fits
    step = let(
        "total", f"acc.used + {tokens('para')}",
        f"named_struct('used', total, 'n', CASE WHEN total <= {max_tokens} THEN acc.n + 1 ELSE acc.n END)",
    )
    fits = f"aggregate(paras, named_struct('used', 0L, 'n', 0), (acc, para) -> {step}).n"
    text = let("n", fits, f"""CASE WHEN n > 0 THEN array_join(slice(paras, 1, n), '\\n')
        WHEN size(paras) > 0 THEN substring(get(paras, 0), 1, {4 * max_tokens}) ELSE '' END""")
    return let("paras", paragraphs(x), text)


def first_sentences(x: str, n: int) -> str:
    """First sentences of a text, newlines read as blanks."""
    flat = strip(replace_all(x, f"[{WS}]+", " "))
    found = f"regexp_extract_all({flat}, '[^.!?؟]+[.!?؟]*', 0)"
    return strip(f"array_join(slice({found}, 1, {n}), '')")


def faq_pairs(x: str) -> str:
    """Array of (line_no, question, answer): a question line and the answer line after it."""
    pair = """transform(rows, (line, i) -> named_struct(
        'line_no', CAST(i + 1 AS BIGINT), 'question', line, 'answer', get(rows, i + 1)))"""
    answered = "qa.question RLIKE '[?؟]$' AND qa.answer IS NOT NULL AND NOT qa.answer RLIKE '[?؟]$'"
    return f"filter({let('rows', paragraphs(x), pair)}, qa -> {answered})"
