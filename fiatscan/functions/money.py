"""Conversions, wallet rules and display formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fiatscan.schemas import LUNA_PER_NIM

ADDRESS = r"(?i)^NQ[0-9A-Z]{2}(\s+[0-9A-Z]{4}){8}$"  # fixed value: the shape of an address


def asset_amount(fiat: Column, rate: Column) -> Column:
    """Asset units for a fiat price; null where the rate is 0."""
    return F.try_divide(fiat, rate)


def luna_to_nim(luna: Column) -> Column:
    return luna / F.lit(float(LUNA_PER_NIM))


def nim_to_luna(nim: Column) -> Column:
    """Whole base units, halves up."""
    return F.floor(nim * LUNA_PER_NIM + 0.5).cast("long")


def affordability(balance: Column, need: Column) -> tuple[Column, Column]:
    """affordable and deficit; both null where the balance is unknown."""
    known = balance.isNotNull()
    return F.when(known, balance >= need), F.when(known, F.when(balance >= need, 0.0).otherwise(need - balance))


def tip_luna(amount: Column) -> Column:
    """Base units of a tip; null unless finite and above 0."""
    fine = amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) != float("inf")) & (amount > 0)
    return F.when(fine, nim_to_luna(amount))


def fixed(amount: Column, digits: int) -> Column:
    """Grouped decimal text, halves away from zero."""
    return F.format_number(F.round(amount, digits), digits)


def compact(amount: Column) -> Column:
    """Two decimals at most with K, M, B or T."""
    scaled = F.round(amount / 1e12, 2), F.round(amount / 1e9, 2), F.round(amount / 1e6, 2), F.round(amount / 1e3, 2)
    trimmed = lambda c: F.regexp_replace(F.format_number(c, 2), r"\.?0+$", "")
    out = trimmed(F.round(amount, 2))
    for value, unit in zip(reversed(scaled), "KMBT"):
        out = F.when(value >= 1, F.concat(trimmed(value), F.lit(unit))).otherwise(out)
    return out


def fiat_text(currency: Column, amount: Column) -> Column:
    return F.when(currency == "JPY", fixed(amount, 0)).otherwise(fixed(amount, 2))


def nim_text(amount: Column) -> Column:
    plain = F.when(amount < 1, fixed(amount, 4)).otherwise(fixed(amount, 2))
    return F.when(amount >= 1_000_000, F.concat(plain, F.lit(" ("), compact(amount), F.lit(")"))).otherwise(plain)


def asset_text(asset: Column, amount: Column) -> Column:
    body = F.when(asset == "NIM", nim_text(amount)).when(asset == "USDT", fixed(amount, 2)).when(asset == "BTC", fixed(amount, 8)).when(asset == "ETH", fixed(amount, 6))
    return F.concat(F.lit("≈ "), body)


def _short(amount: Column, least: int, most: int) -> Column:
    """`most` decimals without trailing zeros beyond `least`."""
    return F.regexp_replace(fixed(amount, most), rf"(\.\d{{{least}}}\d*?)0+$", "$1")


def rate_text(asset: Column, rate: Column) -> Column:
    return F.when(asset == "NIM", _short(rate, 4, 6)).when(asset == "USDT", _short(rate, 2, 4)).otherwise(fixed(rate, 0))


def is_address(address: Column) -> Column:
    return F.trim(address).rlike(ADDRESS)


def short_address(address: Column) -> Column:
    """First and last group; addresses of fewer than three groups as they are."""
    groups = F.split(F.trim(address), r"\s+")
    return F.when(F.size(groups) < 3, address).otherwise(F.concat(groups[0], F.lit(" **** **** "), F.element_at(groups, -1)))


def age_text(then_ms: Column, now_ms: Column) -> Column:
    """12s, or 3m from a minute on; never below 0."""
    seconds = F.greatest(F.lit(0), F.floor((now_ms - then_ms) / 1000))
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))


def number_text(value: Column) -> Column:
    """A number without trailing zeros: 3.99, 10."""
    return F.regexp_replace(value.cast("decimal(30,10)").cast("string"), r"\.?0+$", "")
