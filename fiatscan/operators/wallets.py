"""Wallets: the richest account, values in fiat, and what a balance can pay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiatscan.functions import money
from fiatscan.schemas import WALLET_FRESH_S


def richest(accounts: DataFrame) -> DataFrame:
    """One account a wallet: the greatest readable balance, the first listed of equal ones; with none readable the first, of unknown balance."""
    rank = F.struct(F.col("luna").isNotNull().alias("known"), F.coalesce("luna", F.lit(0)).alias("luna"), (-F.col("account_index")).alias("order"))
    best = accounts.groupBy("wallet_id").agg(F.max_by(F.struct("account_index", "address", "luna"), rank).alias("a"))
    return best.select("wallet_id", "a.account_index", "a.address", money.luna_to_nim(F.col("a.luna")).alias("balance_nim"))


def values(wallets: DataFrame, rates: DataFrame) -> DataFrame:
    """Known balances in every fiat."""
    nim = rates.where("asset = 'NIM'").select("fiat", "rate")
    return wallets.where(F.col("balance_nim").isNotNull()).crossJoin(nim).select("wallet_id", "fiat", (F.col("balance_nim") * F.col("rate")).alias("value"))


def preferred_values(wallets: DataFrame, preferences: DataFrame, rates: DataFrame) -> DataFrame:
    """Balance in the wallet's fiat of choice; null for an unknown balance."""
    nim = rates.where("asset = 'NIM'").select("fiat", "rate")
    return wallets.join(preferences.select("wallet_id", "fiat", "onboarded"), "wallet_id").join(nim, "fiat").select("wallet_id", "fiat", "onboarded", (F.col("balance_nim") * F.col("rate")).alias("value"))


def fresh(updated_at_ms: Column, now_ms: Column, limit_s: int = WALLET_FRESH_S) -> Column:
    return (updated_at_ms > 0) & (now_ms - updated_at_ms < limit_s * 1000)


def affordable(needs: DataFrame, wallets: DataFrame) -> DataFrame:
    """needs (wallet_id, need_nim, ...) with affordable and deficit; both null for an unknown wallet or balance."""
    joined = needs.join(wallets.select("wallet_id", "balance_nim"), "wallet_id", "left")
    can, deficit = money.affordability(F.col("balance_nim"), F.col("need_nim"))
    return joined.withColumns({"affordable": can, "deficit": deficit})
