"""Dimensions and constants shared by the jobs."""

from __future__ import annotations

# Assets with their feed ids, in display order; fiat currencies, in display order.
ASSETS = (("NIM", "nimiq-2"), ("USDT", "tether"), ("BTC", "bitcoin"), ("ETH", "ethereum"))
FIATS = ("EUR", "USD", "GBP", "CHF", "JPY", "CNY", "AUD", "CAD", "INR", "BRL")
SYMBOLS = {"€": "EUR", "$": "USD", "£": "GBP", "¥": "JPY", "₹": "INR"}
LUNA_PER_NIM = 100_000
WHITELIST = "0123456789.,-€$£¥₹ABCDEFGHIJLNPRSUYr "

# Limits of age, confidence, geometry and image quality.
RATES_STALE_S = 300
RATES_TTL_S = 60
WALLET_FRESH_S = 120
MIN_CONFIDENCE = 60
MIN_REGION_AREA = 20
REGION_PADDING = 2
GAP_X, GAP_Y = 24, 32
SUPERSCRIPT_GAP_X = 36
MIN_SHARPNESS, MIN_CONTRAST, MAX_MOTION = 50, 20, 15
