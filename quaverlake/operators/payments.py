"""Payments from both stores as one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.functions.money import major, thousandths
from quaverlake.functions.times import epoch_seconds
from quaverlake.operators.segments import row_index

PLAN_CHANGE = "subscription_update"
COLUMNS = ("id", "platform", "paid_at", "created_at", "amount", "refunded", "currency", "status", "plan",
           "plan_change", "period_start", "period_end")


def _plan(names: dict[str, str], col):
    out = F.lit(None).cast("string")
    for plan, product in names.items():
        out = F.when(col == product, plan).otherwise(out)
    return out


def store_payments(df: DataFrame, products: dict[str, str], carried: Sequence[str] = ()) -> DataFrame:
    """F-15: store transactions; free ones are dropped, a refund is always whole.

    ``products`` maps plan to product id; ``carried`` columns stay.
    """
    price = thousandths(F.col("price"))
    revoked = F.coalesce(F.col("revocationDate"), F.lit(0)) != 0
    bought = epoch_seconds(F.col("purchaseDate"))
    return df.filter(F.coalesce(F.col("price"), F.lit(0)) != 0).select(
        F.col("transactionId").alias("id"), F.lit("apple").alias("platform"), bought.alias("paid_at"),
        bought.alias("created_at"), price.alias("amount"),
        F.when(revoked, price).otherwise(F.lit(0).cast("decimal(18,3)")).alias("refunded"),
        F.lower(F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit("USD"))).alias("currency"),
        F.when(revoked, "refunded").otherwise("paid").alias("status"),
        _plan(products, F.col("productId")).alias("plan"), F.lit(False).alias("plan_change"),
        bought.alias("period_start"), epoch_seconds(F.col("expiresDate")).alias("period_end"), *carried)


def invoice_payments(df: DataFrame, prices: dict[str, str], carried: Sequence[str] = ()) -> DataFrame:
    """F-16: invoices with their nested lines; drafts, voided and zero ones are dropped.

    ``prices`` maps plan to price id; the first plan with a line on the invoice names it; ``carried`` columns stay.
    """
    due, paid = F.coalesce(F.col("amount_due"), F.lit(0)), F.coalesce(F.col("amount_paid"), F.lit(0))
    refunded = F.coalesce(F.col("charge.amount_refunded"), F.lit(0))
    currency = F.coalesce(F.col("currency"), F.lit("usd"))
    settled = F.coalesce(F.col("status") == "paid", F.lit(False))
    state = (F.when(settled & (paid != 0) & (refunded >= paid) & (refunded != 0), "refunded")
             .when(settled, "paid").otherwise("unpaid"))
    lines = F.col("lines")
    plan = F.lit(None).cast("string")
    for name, price in reversed(prices.items()):
        billed = F.array_contains(F.transform(lines, lambda x: F.coalesce(x["price"]["id"], F.lit(""))), price)
        plan = F.when(F.coalesce(billed, F.lit(False)), name).otherwise(plan)

    def times(field: str):
        return F.filter(F.transform(lines, lambda x: x["period"][field]), lambda t: F.coalesce(t, F.lit(0)) != 0)

    keep = ~F.coalesce(F.col("status").isin("draft", "void"), F.lit(False)) & ((due != 0) | (paid != 0))
    return df.filter(keep).select(
        "id", F.lit("stripe").alias("platform"), F.when(settled, F.col("status_transitions.paid_at")).alias("paid_at"),
        F.col("created").alias("created_at"), major(F.when(settled, paid).otherwise(due), currency).alias("amount"),
        major(refunded, currency).alias("refunded"), currency.alias("currency"), state.alias("status"),
        plan.alias("plan"), F.coalesce(F.col("billing_reason") == PLAN_CHANGE, F.lit(False)).alias("plan_change"),
        F.array_min(times("start")).alias("period_start"), F.array_max(times("end")).alias("period_end"), *carried)


def account_payments(subscriptions: DataFrame, stores: DataFrame, invoices: DataFrame) -> DataFrame:
    """What each account has paid for its subscription, ``place`` 1 the newest; only the store that bills it is asked.

    ``subscriptions``: user_id, platform, subscription_id; an account without a subscription id has no payments. ``stores`` and
    ``invoices``: payments with the ``subscription_id`` they are for. An account is billed a few times a month, so its rows are few.
    """
    billed = subscriptions.filter(F.coalesce("subscription_id", F.lit("")) != "").select(
        "user_id", "subscription_id", F.when(F.col("platform") == "apple", "apple").otherwise("stripe").alias("platform"))
    both = stores.select(*COLUMNS, "subscription_id").unionByName(invoices.select(*COLUMNS, "subscription_id"))
    mine = both.join(billed, ["platform", "subscription_id"]).withColumn("__late", -F.coalesce("paid_at", "created_at", F.lit(0)))
    return row_index(mine, ["user_id"], ["__late", "id"], "place").select("user_id", "place", *COLUMNS)
