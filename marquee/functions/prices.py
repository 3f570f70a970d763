"""Prices, offers and model cost."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marquee.dims import COST_RATES, lookup


def parse_price(c: Column) -> Column:
    """Number in a price text. A text without digits (``Free``) is zero."""
    digits = F.regexp_replace(c, r"[^0-9.]", "")
    return F.when(c.isNull(), None).when(digits == "", 0.0).otherwise(digits.try_cast("double"))


def says_free(cost: Column) -> Column:
    return F.coalesce(F.rlike(cost, F.lit(r"(?i)^\s*(free|0|0\.00|\$0)\s*$")), F.lit(False))


def _dollars(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.0f", c))


def format_price(low: Column, high: Column, is_free: Column) -> Column:
    """``Free``, a single amount, a range, or null when unknown."""
    one = F.coalesce(low, high)
    return (
        F.when(is_free, "Free")
        .when(low.isNotNull() & high.isNotNull() & (low != high),
              F.concat(_dollars(low), F.lit(" \u2013 "), _dollars(high)))
        .when(one == 0, "Free")
        .when(one.isNotNull(), _dollars(one))
    )


def currency(c: Column) -> Column:
    return F.substring(F.upper(c), 1, 3)


def model_cost(model: Column, prompt: Column, completion: Column) -> Column:
    """USD for one call; unknown models cost nothing."""
    rate_in = lookup({m: r[0] for m, r in COST_RATES.items()}, model)
    rate_out = lookup({m: r[1] for m, r in COST_RATES.items()}, model)
    return F.coalesce((prompt * rate_in + completion * rate_out) / 1_000_000, F.lit(0.0))


def price_tiers(tiers: Column) -> Column:
    """All tiers, currency to three capitals; ``validate`` flags names that are too long."""

    def clean(t: Column) -> Column:
        return F.struct(
            F.coalesce(t["name"], F.lit("Ticket")).alias("name"),
            F.when(~F.isnan(t["min"]), t["min"]).alias("min"),
            F.when(~F.isnan(t["max"]), t["max"]).alias("max"),
            currency(t["currency"]).alias("currency"),
        )

    return F.when(F.size(tiers) > 0, F.transform(tiers, clean))


def default_offer(offer: Column, page_url: Column, is_free: Column) -> Column:
    """The offer of a page: a missing one points at the page, a missing URL too."""
    status = F.when(is_free, "free").otherwise("on_sale")
    made = F.struct(
        page_url.alias("ticket_url"), status.alias("status"), F.lit("USD").alias("currency"),
        F.lit(None).cast("string").alias("on_sale_local"),
        F.lit(None).cast("string").alias("valid_from_local"),
        offer["tiers"].alias("tiers"),
    )
    return F.when(offer.isNull(), made).otherwise(
        offer.withField("ticket_url", F.coalesce(offer["ticket_url"], page_url)))
