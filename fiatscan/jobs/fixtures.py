"""Input tables of the jobs, derived from the star schema by one SQL text for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fiatscan.schemas import ASSETS, FIATS

# Made up for the jobs: dollars for a unit of each asset, and units of each fiat for a dollar.
_DOLLARS = {"NIM": 0.125, "USDT": 1.0, "BTC": 41_000.0, "ETH": 2_250.0}
_PER_DOLLAR = {"EUR": 0.91, "USD": 1.0, "GBP": 0.78, "CHF": 0.87, "JPY": 148.0, "CNY": 7.1, "AUD": 1.5, "CAD": 1.33, "INR": 83.2, "BRL": 4.95}
RATES = {feed: {f.lower(): round(_DOLLARS[asset] * _PER_DOLLAR[f], 4) for f in FIATS} for asset, feed in ASSETS}

_RATE_VALUES = ", ".join(f"({k}, '{a}', '{f}', {float(RATES[feed][f.lower()])!r}e0)" for k, (a, feed, f) in enumerate((a, feed, f) for a, feed in ASSETS for f in FIATS))
_ASSET_VALUES = ", ".join(f"({i}, '{a}', '{feed}')" for i, (a, feed) in enumerate(ASSETS))
_FIAT_VALUES = ", ".join(f"({i}, '{f}')" for i, f in enumerate(FIATS))
_FEED = ", ".join(f'"{feed}": {{%s}}' % ", ".join(f'"{f.lower()}": {RATES[feed][f.lower()]!r}' for f in FIATS) for _, feed in ASSETS)


def _without(fiat: str) -> str:
    return "{" + ", ".join(f'"{feed}": {{%s}}' % ", ".join(f'"{f.lower()}": {RATES[feed][f.lower()]!r}' for f in FIATS if f != fiat) for _, feed in ASSETS) + "}"


#: name -> (tables it reads, SQL in Spark's dialect)
SOURCES: dict[str, tuple[tuple[str, ...], str]] = {
    "rates": ((), f"select * from (values {_RATE_VALUES}) as r(k, asset, fiat, rate)"),
    "assets": ((), f"select * from (values {_ASSET_VALUES}) as a(asset_ordinal, asset, feed_id)"),
    "fiats": ((), f"select * from (values {_FIAT_VALUES}) as f(fiat_ordinal, fiat)"),
    "price_labels": (
        ("orders",),
        """select o_orderkey as label_id, o_custkey as custkey, case cast(o_orderkey % 12 as int)
 when 0 then '€' || w || '.' || f when 1 then w || ',' || f || ' EUR' when 2 then '$' || w || '.' || f
 when 3 then 'TOTAL € ' || w || ', ' || f when 4 then '£' || g || '.' || f when 5 then 'CHF ' || w || '.' || f
 when 6 then 'Fr. ' || w || '.-' when 7 then 'only ' || w || ',- BRL' when 8 then '¥' || w
 when 9 then 'SPECIAL OFFER ' || w || '.' || f when 10 then '€ ' || s || ' ' || f else 'Open 9am - 5pm' end as text, cents
from (select o_orderkey, o_custkey, cents, cast(cents div 100 as string) as w, lpad(cast(cents % 100 as string), 2, '0') as f,
        cast((cents div 100) % 900 + 100 as string) as s,
        cast((cents div 100) div 1000 as string) || ',' || lpad(cast((cents div 100) % 1000 as string), 3, '0') as g
      from (select o_orderkey, o_custkey, cast(round(o_totalprice * 100) as bigint) as cents from orders) a) b""",
    ),
    "accounts": (
        ("customer",),
        """select c_custkey div 3 as wallet_id, cast(c_custkey % 3 as int) as account_index,
 case when c_custkey % 7 = 0 then 'bad-' || cast(c_custkey as string)
      else 'NQ' || lpad(cast(c_custkey % 100 as string), 2, '0') || ' 0000 0000 0000 0000 0000 0000 0000 '
           || lpad(cast(c_custkey % 10000 as string), 4, '0') end as address,
 case when c_custkey % 11 = 0 then null else cast(round(abs(c_acctbal) * 100) as bigint) * 1000 end as luna
from customer""",
    ),
    "account_responses": (
        ("customer",),
        """select c_custkey as request_id, case
 when c_custkey % 11 = 0 then '{"error": {"message": "Invalid address ' || cast(c_custkey as string) || '"}}'
 when c_custkey % 13 = 0 then '{"jsonrpc": "2.0"}'
 else '{"result": {"data": {"address": "NQ' || lpad(cast(c_custkey % 100 as string), 2, '0') || '", "balance": ' || cast(cast(round(abs(c_acctbal) * 100) as bigint) * 1000 as string) || '}}}' end as payload
from customer""",
    ),
    "wallet_snapshots": (
        ("customer",),
        """select wallet_id, case cast(wallet_id % 12 as int) when 0 then a when 4 then a when 8 then lower(a) when 1 then 'not a wallet'
 when 2 then '{"address": "A' || k || '", "balanceNim": ' || k || ', "updatedAt": ' || t || '}'
 when 3 then '{"address": "' || a || '", "balanceNim": "many", "updatedAt": ' || t || '}'
 when 5 then '{"address": "' || a || '", "balanceNim": ' || k || '.25}'
 when 6 then '{"address": "' || a || '", "balanceNim": ' || k || ', "updatedAt": "' || t || '"}'
 when 7 then '{"x": {"address": "' || a || '", "balanceNim": ' || k || '}}'
 when 9 then '{"address": "' || a || '", "balanceNim": "' || k || '", "updatedAt": ' || t || '}'
 when 10 then '{"address": ' || k || ', "balanceNim": ' || k || '}'
 else '{"address": "' || a || '", "balanceNim": ' || k || ', "updatedAt": ' || t || '}' end as raw
from (select c_custkey as wallet_id, cast(c_custkey as string) as k, cast(1700000000000 + c_custkey * 1000 as string) as t,
        'NQ' || lpad(cast(c_custkey % 100 as string), 2, '0') || ' 0000 0000 0000 0000 0000 0000 0000 ' || lpad(cast(c_custkey % 10000 as string), 4, '0') as a from customer) c""",
    ),
    "preferences": (
        ("customer", "fiats"),
        """select c_custkey div 3 as wallet_id, case cast(c_custkey % 24 as int) when 0 then 'broken'
 when 3 then '{"fiatCurrency": "' || coalesce(fiat, 'XXX') || '", "x": {"onboardingComplete": true}}'
 when 9 then '{"fiatCurrency": "' || coalesce(fiat, 'XXX') || '", "onboardingComplete": "true"}'
 when 15 then '{"x": {"fiatCurrency": "' || coalesce(fiat, 'XXX') || '"}, "onboardingComplete": true}'
 when 21 then '{"fiatCurrency": ' || cast(c_custkey as string) || ', "onboardingComplete": true}'
 else '{"fiatCurrency": "' || coalesce(fiat, 'XXX') || '", "onboardingComplete": ' || case when c_custkey % 4 = 0 then 'false' else 'true' end || '}' end as raw
from customer left join fiats on fiat_ordinal = c_nationkey % 12 where c_custkey % 3 = 0""",
    ),
    "raw_feeds": (
        ("events",),
        f"""select day, case when snapshot_id % 7 = 0 then 'not json' when snapshot_id % 5 = 0 then '{_without("BRL")}' else '{{{_FEED}}}' end as payload, snapshot_id
from (select distinct cast(date_trunc('hour', ts) as timestamp) as day, cast(hour(ts) + 24 * day(ts) as bigint) as snapshot_id from events) d""",
    ),
    "readings": (
        ("events",),
        """select user_id as session_id, event_id as seq, ts,
 case when event_type = 'error' then null else cast(event_id % 2 as int) + 0.99e0 end as amount,
 case when event_type = 'error' then null when event_type = 'view' then 'USD' else 'EUR' end as currency
from events""",
    ),
    "rate_requests": (("events",), "select user_id as instance_id, event_id as seq, ts, event_type <> 'error' as fetch_ok from events"),
    "rate_ticks": (
        ("events", "rates"),
        """select t.ts, t.event_id, d.asset, d.fiat, d.rate * (1 + ((t.event_id * 7 + d.k) % 21 - 10) / 1000.0e0) as rate, t.event_id % 3 = 0 as stale
from events t join rates d on t.event_id % 40 = d.k where t.event_type = 'signup'""",
    ),
    "priced_events": (
        ("events", "rates"),
        "select t.event_id, t.ts, d.asset, d.fiat, cast(t.event_id % 500 as double) + 0.99e0 as amount from events t join rates d on t.event_id % 40 = d.k where t.event_type = 'purchase'",
    ),
    "fragments": (
        ("lineitem",),
        """select l_orderkey div 10 as image_id, cast(l_orderkey % 2 as int) as crop_idx, cast(l_orderkey % 10 div 2 as int) as variant_idx, cast(rn as int) as frag_idx,
 case cast((l_partkey + rn) % 5 as int) when 0 then '$' when 1 then cast(l_partkey % 900 + 100 as string)
   when 2 then lpad(cast(l_suppkey % 100 as string), 2, '0') when 3 then cast(l_partkey % 10 as string)
   else '$' || cast(l_partkey % 900 + 100 as string) end as text,
 cast(50 + l_suppkey % 50 as int) as confidence, cast(40 + l_partkey % 60 as int) as digit_confidence,
 cast(rn * 30 + l_partkey % 20 as int) as x, cast(l_suppkey % 20 as int) as y,
 cast(8 + l_partkey % 40 as int) as width, cast(10 + l_suppkey % 25 as int) as height
from (select *, row_number() over (partition by l_orderkey
        order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as rn from lineitem) z""",
    ),
    "images": (("part",), "select p_partkey as image_id, cast(p_size * 37 + 200 as int) as width, cast(p_size * 21 + 90 as int) as height from part"),
}

_DEPENDS = {"priced_events": ("rates",), "rate_ticks": ("rates",), "preferences": ("fiats",), "pictures": ("frames",)}
_FRAMES_SPARK = """select vec_id as frame_id, label as session_id, vec_id as seq, 8 as width, 8 as height,
 transform(embedding, v -> cast(least(255, greatest(0, floor(128 + 512 * cast(v as double) + 0.5e0))) as int)) as gray from embeddings"""
_FRAMES_DUCK = """select vec_id as frame_id, label as session_id, vec_id as seq, 8 as width, 8 as height,
 list_transform(embedding, lambda v: cast(least(255, greatest(0, floor(128 + 512 * cast(v as double) + 0.5e0))) as int)) as gray from embeddings"""
SOURCES["frames"] = (("embeddings",), _FRAMES_SPARK)
# pictures of 64 x 32 pixels: 32 frames in four rows of eight
_PLACED = "{patches}[(i div 512) * 8 + (i % 64) div 8 {one}][(i div 64 % 8) * 8 + i % 8 {one}]"
SOURCES["pictures"] = (
    ("frames",),
    f"""select image_id, 64 as width, 32 as height, transform(sequence(0, 2047), i -> {_PLACED.format(patches="patches.gray", one="")}) as gray
from (select frame_id div 32 as image_id, array_sort(collect_list(struct(frame_id, gray))) as patches from frames group by frame_id div 32 having count(*) = 32) p""",
)
_PICTURES_DUCK = f"""select image_id, 64 as width, 32 as height, list_transform(range(2048), lambda i: {_PLACED.format(patches="patches", one="+ 1").replace("div", "//")}) as gray
from (select frame_id // 32 as image_id, list(gray order by frame_id) as patches from frames group by frame_id // 32 having count(*) = 32) p"""


def load(spark: SparkSession, sf_dir: str, name: str, streamed: DataFrame | None = None) -> DataFrame:
    """The derived table `name` of a data folder; `streamed` stands in for the stored table that it reads."""
    needs, sql = SOURCES[name]
    stored = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet") if streamed is None else streamed
    given = {t: load(spark, sf_dir, t) if t in SOURCES else stored(t) for t in needs}
    for t in needs:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 fixture_{t}", sql)
    for t in needs:
        given[t].createOrReplaceTempView(f"fixture_{t}")
    return spark.sql(sql)


def duck(name: str) -> str:
    """The derived table `name` in DuckDB's dialect."""
    sql = {"frames": _FRAMES_DUCK, "pictures": _PICTURES_DUCK}.get(name, SOURCES[name][1])
    return re.sub(r"\bdiv\b", "//", re.sub(r"as string\b", "as varchar", sql))


def with_tables(*names: str) -> str:
    """A WITH clause of derived tables, those that they need first."""
    order: list[str] = []
    for name in names:
        for need in (*_DEPENDS.get(name, ()), name):
            if need not in order:
                order.append(need)
    return "with recursive " + ",\n".join(f"{n} as ({duck(n)})" for n in order)
