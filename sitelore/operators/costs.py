"""Token and money roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitelore.functions import pricing as P, vocab as V


def by_model(usage: DataFrame) -> DataFrame:
    """Token sums per (run, model); calls without a model count for the cheap one."""
    model = F.coalesce(F.nullif("model", F.lit("")), F.lit(V.CHEAP_MODEL))
    none = F.lit(0)
    return usage.groupBy("run_id", model.alias("model")).agg(
        F.sum(F.coalesce("prompt_tokens", none)).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", none)).alias("completion_tokens"),
    )


def _cost() -> Column:
    return F.expr(P.cost("model", "prompt_tokens", "completion_tokens"))


def cost_by_model(usage: DataFrame) -> DataFrame:
    return by_model(usage).withColumn(
        "cost_usd", F.expr(P.usd(P.cost("model", "prompt_tokens", "completion_tokens"))).cast("double")
    )


def cost_estimate(usage: DataFrame) -> DataFrame:
    """Run totals: the unrounded model costs are added in model order, then formatted."""
    costs = F.transform(
        F.array_sort(F.collect_list(F.struct("model", _cost().alias("cost")))), lambda x: x["cost"]
    )
    total = F.aggregate(costs, F.lit(0.0), lambda acc, c: acc + c)
    return by_model(usage).groupBy("run_id").agg(
        total.alias("total"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    ).select("run_id", F.expr(P.usd("total")).alias("total_cost_usd"), "prompt_tokens", "completion_tokens")


def price_of(
    calls: DataFrame, prices: DataFrame, default: tuple[float, float] = V.DEFAULT_PRICE, at: str | None = None
) -> DataFrame:
    """The calls with ``input`` and ``output``, $ per million tokens, from a table of prices (name, input, output).

    The longest name that the model's name starts with counts; without one, the default.  With ``at``, the column of
    a call's time, prices also have ``valid_from``: a name counts from its first price on, and of its prices the
    newest by then (a null counts from ever).  Each distinct model (and time) is cut into its
    prefixes once and those are joined by equality, so the table may be of any size.
    """
    on = ["model"] + ([at] if at else [])
    asked = calls.select(*on).distinct().filter("model IS NOT NULL")
    prefixes = asked.select("*", F.explode(F.sequence(F.lit(1), F.length("model"))).alias("_k")).select(
        *on, F.col("_k"), F.expr("substring(model, 1, _k)").alias("name")
    ).filter("name <> ''")
    since = F.col("valid_from") if at else F.lit(None).cast("timestamp")
    known = prices.select("name", "input", "output", since.alias("_since")).filter("name IS NOT NULL")
    found = prefixes.join(known, "name")
    if at:
        found = found.filter(F.col("_since").isNull() | (F.col("_since") <= F.col(at)))
    newest = F.struct(F.col("_k"), F.col("_since").isNotNull(), F.col("_since"))
    best = found.groupBy(*on).agg(F.max_by(F.struct("input", "output"), newest).alias("_p"))
    keep = [c for c in calls.columns if c not in ("input", "output")]
    same = " AND ".join(f"c.{c} <=> p.{c}" for c in on)
    return calls.select(*keep).alias("c").join(best.alias("p"), F.expr(same), "left").select(
        *[F.col(f"c.{c}") for c in keep],
        *[F.coalesce(F.col(f"p._p.{n}"), F.lit(d)).alias(n) for n, d in zip(("input", "output"), default)],
    )


def cost_at_prices(usage: DataFrame, prices: DataFrame, at: str | None = None) -> DataFrame:
    """Token sums and cost per (run, model) at the prices of a table; see ``price_of``."""
    model = F.coalesce(F.nullif("model", F.lit("")), F.lit(V.CHEAP_MODEL))
    none = F.lit(0)
    sums = usage.groupBy("run_id", model.alias("model"), *([at] if at else [])).agg(
        F.sum(F.coalesce("prompt_tokens", none)).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", none)).alias("completion_tokens"),
    )
    # tokens times millionths of a dollar, in whole numbers, so that sums don't depend on their order
    micro = lambda tokens, price: F.col(tokens).cast("decimal(20,0)") * F.round(F.col(price) * 1000000).cast("decimal(18,0)")
    whole = F.sum(micro("prompt_tokens", "input") + micro("completion_tokens", "output"))
    return price_of(sums, prices, at=at).groupBy("run_id", "model").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        (whole.cast("double") / 1e12).alias("cost_usd"),
    )


def cost_flat(usage: DataFrame) -> DataFrame:
    """Run totals priced at the cheap rate whatever the model."""
    sums = usage.groupBy("run_id").agg(
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"),
    )
    flat = P.flat_cost("prompt_tokens", "completion_tokens")
    return sums.withColumn("total_cost_usd", F.expr(P.usd(flat)))
