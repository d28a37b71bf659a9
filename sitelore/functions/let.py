"""Building blocks of the SQL expressions in this package.

The functions of this package take and give Spark SQL expressions as text, for ``F.expr`` and
``selectExpr``: one parse in the JVM instead of thousands of column calls, and readable plans.
"""

from __future__ import annotations

import re


def lit(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(items) -> str:
    """SQL list of string literals, for IN."""
    return "(" + ", ".join(lit(i) for i in items) + ")"


def any_of(words) -> str:
    """Regex that matches when any of the words occurs."""
    return "|".join(re.escape(w) for w in words)


def contains_any(x: str, words) -> str:
    return f"({x} RLIKE {lit(any_of(words))})"


def mapping(pairs: dict) -> str:
    """SQL map with string keys."""
    value = lambda v: lit(v) if isinstance(v, str) else str(v)
    return "map(" + ", ".join(f"{lit(k)}, {value(v)}" for k, v in pairs.items()) + ")"


def let(name: str, value: str, body: str) -> str:
    """Name a computed value inside an expression.

    Catalyst substitutes aliases when it merges projections and pushes filters, so an expression
    that reads a computed column ten times becomes ten copies of it.  Binding the value to a lambda
    variable keeps the tree small and the value computed once.
    """
    return f"transform(array({value}), {name} -> {body})[0]"
