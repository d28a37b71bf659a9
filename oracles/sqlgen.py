"""Small helpers to write the checking SQL: expression snippets and shared CTEs."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def variant(prefix: str, roots: dict[str, str]) -> None:
    """Copies, under prefixed names, of all CTEs that depend on those in ``roots``, which get new SQL."""
    renamed: dict[str, str] = {}
    for name, text in list(CTES.items()):
        new = roots.get(name)
        if new is None:
            new = text
            for old in renamed:
                new = re.sub(rf"\b{old}\b", prefix + old, new)
            if new == text:
                continue
        renamed[name] = new
        CTES[prefix + name] = new


def build(sql: str, recursive: bool = False) -> str:
    """Put the CTEs a statement needs in front of it, in the order they were declared."""
    needed, stack = set(), [sql]
    while stack:
        text = stack.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                stack.append(CTES[name])
    if not needed:
        return sql
    parts = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed)
    if recursive or sql.lstrip().upper().startswith("WITH RECURSIVE"):
        body = re.sub(r"(?is)^\s*WITH\s+RECURSIVE\s+", "", sql)
        return f"WITH RECURSIVE {parts},\n{body}"
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {parts},\n" + re.sub(r"(?is)^\s*WITH\s+", "", sql)
    return f"WITH {parts}\n{sql}"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def arr(items) -> str:
    return "[" + ", ".join(q(i) if isinstance(i, str) else ("NULL" if i is None else str(i)) for i in items) + "]"


def has(expr: str, words) -> str:
    """True when the text holds any of the words as a substring."""
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def scheme(u):
    return f"lower(regexp_extract({u}, {q(SCHEME_RE)}, 1))"


def after_scheme(u):
    return f"regexp_replace({u}, {q(SCHEME_RE)}, '')"


def netloc(u):
    return f"regexp_extract({after_scheme(u)}, '^//([^/?#]*)', 1)"


def rawpath(u):
    return f"regexp_extract(regexp_replace({after_scheme(u)}, '^//[^/?#]*', ''), '(?s)^[^?#]*', 0)"


def path(u):
    return f"regexp_replace({rawpath(u)}, ';[^/]*$', '')"


def query(u):
    return f"regexp_extract(split_part({u}, '#', 1), '(?s)\\?(.*)$', 1)"


def fragment(u):
    return f"CASE WHEN {u} IS NULL THEN NULL WHEN contains({u}, '#') THEN substring({u}, instr({u}, '#') + 1) ELSE '' END"


def norm(u):
    cut = f"regexp_replace(split_part({u}, '#', 1), '\\?$', '')"
    head = f"regexp_extract({cut}, '^[A-Za-z][A-Za-z0-9+.\\-]*:', 0)"
    return f"(lower({head}) || substring({cut}, length({head}) + 1))"


def strip(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def rep(x, pattern, by="", flags="g"):
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, {q(flags)})"


def unescape(x):
    names = {"copy": "©", "middot": "·", "nbsp": chr(160), "quot": '"', "apos": "'", "lt": "<", "gt": ">"}
    out = x
    for n, c in names.items():
        out = f"replace({out}, '&{n};', {q(c)})"
    out = f"replace({out}, '&amp;', '&')"
    return rep(out, "&amp([^A-Za-z0-9;]|$)", r"&\1")


def drop(x, tags, by=""):
    for t in tags:
        x = rep(x, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", by)
    return x


def no_scripts(x, by=""):
    return rep(drop(x, ["script", "style"], by), "(?s)<!--.*?-->", by)


def body(x):
    return rep(rep(x, r"(?is)^.*?<body\b[^>]*>"), r"(?is)</body\s*>.*$")


def lines(x):
    """Trimmed, non-empty pieces between tags, joined by newlines."""
    marked = unescape(rep(x, r"<[/!?A-Za-z][^>]*>", "\x01"))
    return (
        f"array_to_string(list_filter(list_transform(string_split({marked}, '\x01'), "
        f"lambda piece: {strip('piece')}), lambda piece: piece <> ''), chr(10))"
    )


def clean(x):
    boiler = ["nav", "footer", "header", "noscript", "svg", "form", "iframe"]
    return rep(lines(drop(body(no_scripts(x, "<br>")), boiler, "<br>")), r"\n{3,}", "\n\n")


def toks(x):
    return f"CASE WHEN coalesce(length({x}), 0) = 0 THEN 0 ELSE greatest(1, length({x}) // 4) END"


def paras(x):
    return (
        f"list_filter(list_transform(string_split({x}, chr(10)), lambda piece: {strip('piece')}), "
        f"lambda piece: piece <> '')"
    )


def pkey(x):
    return f"lower({rep(x, WS + '+', ' ')})"
