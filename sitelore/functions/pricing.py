"""Model price expressions."""

from __future__ import annotations

from sitelore.functions import vocab as V
from sitelore.functions.let import lit


def price(model: str, which: str, prices=V.PRICES, default=V.DEFAULT_PRICE) -> str:
    """$ per million tokens of the longest known prefix of the model name, else the default.

    The exact name is its own longest prefix, so one CASE ordered by length settles both.
    """
    side = {"input": 0, "output": 1}[which]
    tests = " ".join(
        f"WHEN startswith({model}, {lit(name)}) THEN {prices[name][side]}D"
        for name in sorted(prices, key=len, reverse=True)
    )
    return f"CASE {tests} ELSE {default[side]}D END"


def cost(model: str, prompt: str, completion: str, **prices) -> str:
    return (
        f"({prompt} / 1000000 * {price(model, 'input', **prices)}"
        f" + {completion} / 1000000 * {price(model, 'output', **prices)})"
    )


def flat_cost(prompt: str, completion: str) -> str:
    """Cheap rate whatever the model."""
    inp, out = V.DEFAULT_PRICE
    return f"({prompt} / 1000000 * {inp}D + {completion} / 1000000 * {out}D)"


def usd(amount: str) -> str:
    """Amount as text with six digits, rounded from its exact binary value."""
    return f"format_number({amount}, '0.000000')"
