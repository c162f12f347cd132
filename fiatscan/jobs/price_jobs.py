"""Price texts: detected, cleaned, converted, formatted and summed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiatscan.functions import money, text_price
from fiatscan.functions.text_price import BLANKS, CODES, NUMBER, SYMBOL
from fiatscan.operators import rates as rate_ops
from fiatscan.schemas import SYMBOLS, WHITELIST

from .core import job
from .fixtures import load, with_tables

_LEAD = r"((?s:^.?|[^0-9].|.\S))"
_REPAIRS = (
    (r"(\d)\s*([.,])\s*(\d)", r"\1\2\3", "g"),
    (r"(\d+)\s*[.,]\s*-+", r"\1,00", "g"),
    (rf"({SYMBOL}\s*)0(\d{{2}})\b", r"\10,\2", "g"),
    (rf"({SYMBOL}\s*)(\d{{1,3}})\s+(\d{{2}})\b", r"\1\2,\3", "g"),
    (rf"\b({CODES})\s*0(\d{{2}})\b", r"\1 0,\2", "gi"),
    (rf"\b({CODES})\s+(\d{{1,3}})\s+(\d{{2}})\b", r"\1 \2,\3", "gi"),
    (rf"\b0(\d{{2}})\s*({CODES})\b", r"0,\1 \2", "gi"),
    (rf"{_LEAD}\b(\d{{1,3}})\s+(\d{{2}})\s*({CODES})\b", r"\1\2,\3 \4", "gi"),
)


def detect_sql(source: str, want: str = "cast(null as varchar)", prefix: str = "") -> str:
    """CTEs that add amount and currency to `source`, which has a column text; the last is `{prefix}detected`."""
    text = f"case when regexp_matches(text, '[0-9]') then translate(text, '{BLANKS}', '{' ' * len(BLANKS)}') end"
    for pattern, replacement, flags in _REPAIRS:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', '{flags}')"
    symbols = " ".join(f"when '{s}' then '{c}'" for s, c in SYMBOLS.items())
    x = lambda pattern, group, flags="": f"nullif(regexp_extract(t, '{pattern}', {group}{', ' + chr(39) + flags + chr(39) if flags else ''}), '')"
    lead_cents = rf"{_LEAD}\b(\d{{1,3}})\s+(\d{{2}})\b"
    return f"""
{prefix}d1 as (select *, {text} as t, {want} as want from {source}),
{prefix}d2 as (select *, {x(f'({SYMBOL})\\s?({NUMBER})', 1)} as sym, {x(f'({SYMBOL})\\s?({NUMBER})', 2)} as sym_raw, {x(f'(?:CHF|Fr\\.?)\\s?({NUMBER})', 1, 'i')} as fr_raw,
  {x(r'\b(\d+[.,]\d{2})\b', 1)} as bare, {x(lead_cents, 2)} || '.' || {x(lead_cents, 3)} as spaced,
  {x(f'({NUMBER})\\s?({CODES})', 2, 'i')} as after_code, {x(f'({NUMBER})\\s?({CODES})', 1, 'i')} as after_raw,
  {x(f'({CODES})\\s?({NUMBER})', 1, 'i')} as before_code, {x(f'({CODES})\\s?({NUMBER})', 2, 'i')} as before_raw from {prefix}d1),
{prefix}d3 as (select *, case when sym is not null then case sym {symbols} end when fr_raw is not null then 'CHF' end as explicit from {prefix}d2),
{prefix}d4 as (select *, case when explicit is not null then case when want is not null and want <> explicit then null else coalesce(sym_raw, fr_raw) end
    when want is not null and coalesce(bare, spaced) is not null then coalesce(bare, spaced) else coalesce(after_raw, before_raw) end as raw,
  case when explicit is not null then explicit when want is not null and coalesce(bare, spaced) is not null then want else upper(coalesce(after_code, before_code)) end as cur from {prefix}d3),
{prefix}d5 as (select *, case when contains(raw, ',') and contains(raw, '.') then
    case when length(regexp_extract(raw, '[^,]*$')) < length(regexp_extract(raw, '[^.]*$')) then replace(replace(raw, '.', ''), ',', '.') else replace(raw, ',', '') end
    when regexp_matches(raw, '^[^.,]*[.,][^.,]{{2}}$') then replace(raw, ',', '.') else replace(replace(raw, ',', ''), '.', '') end as num from {prefix}d4),
{prefix}detected as (select * exclude (num, cur, raw, t, want), try_cast(regexp_extract(num, '^\\d+(?:\\.\\d*)?') as double) as amount,
  case when try_cast(regexp_extract(num, '^\\d+(?:\\.\\d*)?') as double) is not null then cur end as currency from {prefix}d5)"""


def detected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_price.detect(load(spark, sf_dir, "price_labels"), "text")


@job(with_tables("price_labels", "rates") + "," + detect_sql("price_labels") + """
select asset, currency as fiat, count(*) as n_prices, cast(sum(cast(amount as decimal(28,2))) as double) as sum_fiat,
  round(cast(sum(cast(amount / rate as decimal(38,10))) as double), 4) as sum_asset
from detected join rates on fiat = currency where amount > 0 group by asset, currency""")
def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: labels detected, converted to every asset, summed by asset and currency."""
    priced = rate_ops.convert(detected_labels(spark, sf_dir), load(spark, sf_dir, "rates"))
    sums = priced.groupBy("asset", F.col("currency").alias("fiat")).agg(
        F.count("*").alias("n_prices"), F.sum(F.col("amount").cast("decimal(28,2)")).cast("double").alias("sum_fiat"), F.sum(F.col("asset_amount").cast("decimal(38,10)")).cast("double").alias("sum_asset")
    )
    return sums.withColumn("sum_asset", F.round("sum_asset", 4))


@job(with_tables("price_labels") + "," + detect_sql("price_labels") + " select label_id, amount, currency from detected")
def price_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of each label, without a scan currency."""
    return detected_labels(spark, sf_dir).select("label_id", "amount", "currency")


@job(with_tables("price_labels") + "," + detect_sql("price_labels", "case cast(label_id // 12 % 3 as int) when 0 then 'EUR' when 1 then 'USD' end") + " select label_id, amount, currency from detected")
def price_detect_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of each label under a scan currency that differs by row."""
    labels = load(spark, sf_dir, "price_labels")
    turn = F.expr("label_id div 12 % 3")
    return text_price.detect(labels, "text", F.when(turn == 0, "EUR").when(turn == 1, "USD")).select("label_id", "amount", "currency")


@job("with " + detect_sql("documents", "case when doc_id % 2 = 0 then 'EUR' end").strip() + " select doc_id, amount, currency from detected")
def price_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts, most without a price."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return text_price.detect(docs, "text", F.when(F.col("doc_id") % 2 == 0, "EUR")).select("doc_id", "amount", "currency")


@job(with_tables("price_labels") + f"""
select label_id, regexp_replace(text, '[^{WHITELIST.replace("-", chr(92) + "-")}]', '', 'g') as clean, trim(regexp_replace(text, '\\s+', ' ', 'g')) as squeezed from price_labels""")
def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels reduced to the recogniser's characters, and with single spaces."""
    labels = load(spark, sf_dir, "price_labels")
    return labels.select("label_id", text_price.whitelisted(F.col("text")).alias("clean"), text_price.squeezed(F.col("text")).alias("squeezed"))


@job(with_tables("fragments") + """
select image_id, crop_idx, variant_idx, frag_idx, regexp_matches(text, '[€$£¥₹]') and not regexp_matches(text, '\\d') as is_symbol,
  not regexp_full_match(text, '\\d{2}') and (regexp_full_match(text, '\\$?\\d{1,4}') or regexp_full_match(text, '\\d+')) as is_integer,
  regexp_full_match(text, '\\d{2}') as is_cents, regexp_full_match(text, '\\d') as is_cent_digit, regexp_matches(text, '[€$£¥₹]\\s*\\d{2,}') as is_atomic from fragments""")
def fragment_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fragment looks like."""
    fragments = load(spark, sf_dir, "fragments")
    kinds = text_price.fragment_class(text_price.squeezed(F.col("text")))
    return fragments.select("image_id", "crop_idx", "variant_idx", "frag_idx", *[kinds[k].alias(k) for k in ("is_symbol", "is_integer", "is_cents", "is_cent_digit", "is_atomic")])


_FMT = "format('{{:,.{d}f}}', cast(round(cast(cast({x} as varchar) as decimal(38,18)), {d}) as double))"


def fmt_sql(x: str, digits: int) -> str:
    return _FMT.format(x=x, d=digits)


def compact_sql(x: str) -> str:
    trimmed = lambda y: f"regexp_replace({fmt_sql(y, 2)}, '\\.?0+$', '')"
    cases = " ".join(f"when round({x} / {size}, 2) >= 1 then {trimmed(f'{x} / {size}')} || '{unit}'" for unit, size in (("T", "1e12"), ("B", "1e9"), ("M", "1e6"), ("K", "1e3")))
    return f"case {cases} else {trimmed(x)} end"


def nim_sql(x: str) -> str:
    return f"(case when {x} < 1 then {fmt_sql(x, 4)} else {fmt_sql(x, 2)} end || case when {x} >= 1000000 then ' (' || {compact_sql(x)} || ')' else '' end)"


_ASSET_TEXT = f"'≈ ' || case asset when 'NIM' then {nim_sql('a')} when 'USDT' then {fmt_sql('a', 2)} when 'BTC' then {fmt_sql('a', 8)} else {fmt_sql('a', 6)} end"
_RATE_TEXT = f"case asset when 'NIM' then regexp_replace({fmt_sql('rate', 6)}, '(\\.\\d{{4}}\\d*?)0+$', '\\1') when 'USDT' then regexp_replace({fmt_sql('rate', 4)}, '(\\.\\d{{2}}\\d*?)0+$', '\\1') else {fmt_sql('rate', 0)} end"


@job(with_tables("price_labels", "rates") + "," + detect_sql("price_labels") + f""", c as (select label_id, asset, currency, amount, rate, amount / rate as a from detected join rates on fiat = currency where amount > 0)
select label_id, asset, {_ASSET_TEXT} as asset_text, case when currency = 'JPY' then {fmt_sql('amount', 0)} else {fmt_sql('amount', 2)} end as fiat_text, {_RATE_TEXT} as rate_text from c""")
def price_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display texts of every conversion."""
    priced = rate_ops.convert(detected_labels(spark, sf_dir), load(spark, sf_dir, "rates"))
    return priced.select("label_id", "asset", money.asset_text(F.col("asset"), F.col("asset_amount")).alias("asset_text"), money.fiat_text(F.col("currency"), F.col("amount")).alias("fiat_text"), money.rate_text(F.col("asset"), F.col("rate")).alias("rate_text"))
