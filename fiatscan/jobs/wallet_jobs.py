"""Account answers, wallet choice, valuation, affordability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiatscan.functions import money
from fiatscan.operators import rates as rate_ops
from fiatscan.operators import wallets
from fiatscan.sources import feeds

from .core import job
from .fixtures import load, with_tables
from .price_jobs import detect_sql, detected_labels, nim_sql

_VALID = "regexp_full_match(trim(address), 'NQ[0-9A-Z]{2}(\\s+[0-9A-Z]{4}){8}', 'i')"
_RICHEST = f""", ranked as (select *, row_number() over (partition by wallet_id order by luna desc nulls last, account_index) as rn from accounts where {_VALID}),
richest as (select wallet_id, account_index, address, luna / 100000.0e0 as balance_nim from ranked where rn = 1)"""


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = load(spark, sf_dir, "accounts")
    return wallets.richest(accounts.where(money.is_address(F.col("address"))))


@job(with_tables("account_responses") + """, r as (select request_id, json_extract_string(payload, '$.error.message') as failed, json_extract_string(payload, '$.result.data.address') as address, try_cast(json_extract_string(payload, '$.result.data.balance') as bigint) as luna from account_responses)
select request_id, case when failed is not null then failed when luna is null then 'no result' else 'ok' end as status, address, luna, luna / 100000.0e0 as balance_nim from r""")
def account_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account answers read into balances or errors."""
    out = feeds.parse_accounts(load(spark, sf_dir, "account_responses"))
    return out.select("request_id", "status", "address", "luna", money.luna_to_nim(F.col("luna")).alias("balance_nim"))


@job(with_tables("accounts") + _RICHEST + f"""
select wallet_id, account_index, split_part(address, ' ', 1) || ' **** **** ' || split_part(address, ' ', 9) as short_address, balance_nim, cast(floor(balance_nim * 100000 + 0.5) as bigint) as luna_again,
  {nim_sql('balance_nim')} as balance_text from richest""")
def wallet_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The richest valid account of each wallet."""
    best = chosen(spark, sf_dir)
    return best.select("wallet_id", "account_index", money.short_address(F.col("address")).alias("short_address"), "balance_nim", money.nim_to_luna(F.col("balance_nim")).alias("luna_again"), money.nim_text(F.col("balance_nim")).alias("balance_text"))


@job(with_tables("accounts", "rates") + _RICHEST + " select wallet_id, fiat, round(balance_nim * rate, 6) as value from richest, rates where asset = 'NIM' and balance_nim is not null")
def wallet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances in all fiats."""
    return wallets.values(chosen(spark, sf_dir), load(spark, sf_dir, "rates")).withColumn("value", F.round("value", 6))


# A record counts only with a known fiat, which must be a string; only the JSON value true is onboarded.
_PREFERENCES = """, prefs as (select wallet_id, case when json_valid(raw) then raw::json end as j from preferences),
kept_prefs as (select wallet_id, case when json_type(j, '$.fiatCurrency') = 'VARCHAR' and json_extract_string(j, '$.fiatCurrency') in (select fiat from fiats) then j end as j from prefs),
chosen_fiat as (select wallet_id, coalesce(json_extract_string(j, '$.fiatCurrency'), 'EUR') as fiat, coalesce(json_type(j, '$.onboardingComplete') = 'BOOLEAN' and json_extract_string(j, '$.onboardingComplete') = 'true', false) as onboarded from kept_prefs)"""


@job(with_tables("accounts", "rates", "preferences") + _RICHEST + _PREFERENCES + " select wallet_id, fiat, onboarded, round(balance_nim * rate, 6) as value from richest join chosen_fiat using (wallet_id) join rates using (fiat) where asset = 'NIM'")
def wallet_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances in the fiat of choice."""
    preferences = feeds.parse_preferences(load(spark, sf_dir, "preferences"))
    return wallets.preferred_values(chosen(spark, sf_dir), preferences, load(spark, sf_dir, "rates")).withColumn("value", F.round("value", 6))


NOW_MS = 1_700_000_900_000


@job(with_tables("wallet_snapshots") + f""", s as (select wallet_id, raw, case when json_valid(raw) then raw::json end as j from wallet_snapshots),
named as (select wallet_id, j, case when j is null then raw when json_type(j, '$.address') = 'VARCHAR' then json_extract_string(j, '$.address') end as a from s),
good as (select wallet_id, j, case when regexp_full_match(trim(a), 'NQ[0-9A-Z]{{2}}(\\s+[0-9A-Z]{{4}}){{8}}', 'i') then a end as address from named),
p as (select wallet_id, address, case when address is not null and json_type(j, '$.balanceNim') in ('UBIGINT', 'BIGINT', 'DOUBLE') then cast(json_extract_string(j, '$.balanceNim') as double) end as balance_nim,
  case when address is not null then case when json_type(j, '$.updatedAt') in ('UBIGINT', 'BIGINT', 'DOUBLE') then cast(json_extract_string(j, '$.updatedAt') as bigint) else 0 end end as updated_at from good)
select wallet_id, address, balance_nim, updated_at, updated_at > 0 and {NOW_MS} - updated_at < 120000 as fresh from p""")
def wallet_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored snapshots of two formats, and whether they are fresh at a given time."""
    out = feeds.parse_wallets(load(spark, sf_dir, "wallet_snapshots"))
    return out.select("wallet_id", "address", "balance_nim", "updated_at", wallets.fresh(F.col("updated_at"), F.lit(NOW_MS)).alias("fresh"))


@job(with_tables("accounts", "rates", "price_labels") + _RICHEST + "," + detect_sql("price_labels") + """, needs as (select label_id, custkey // 3 as wallet_id, amount / rate as need_nim from detected join rates on fiat = currency where asset = 'NIM' and amount > 0)
select label_id, wallet_id, round(need_nim, 5) as need_nim, case when balance_nim is not null then balance_nim >= need_nim end as affordable,
  case when balance_nim is not null then round(case when balance_nim >= need_nim then 0 else need_nim - balance_nim end, 5) end as deficit, cast(floor(need_nim * 100000 + 0.5) as bigint) as tip_luna
from needs left join richest using (wallet_id)""")
def affordability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each label's wallet can pay its price."""
    priced = rate_ops.convert(detected_labels(spark, sf_dir), load(spark, sf_dir, "rates")).where("asset = 'NIM'")
    needs = priced.select("label_id", F.expr("custkey div 3").alias("wallet_id"), F.col("asset_amount").alias("need_nim"))
    out = wallets.affordable(needs, chosen(spark, sf_dir))
    return out.select("label_id", "wallet_id", F.round("need_nim", 5).alias("need_nim"), "affordable", F.round("deficit", 5).alias("deficit"), money.tip_luna(F.col("need_nim")).alias("tip_luna"))
