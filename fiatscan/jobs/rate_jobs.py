"""Rate snapshots: accepted, serialised, as of a time, aged, replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiatscan.functions import money
from fiatscan.functions.times import micros
from fiatscan.operators import rates as rate_ops
from fiatscan.sources import feeds

from .core import job
from .fixtures import load, with_tables

DAY_S = 86_400

_PAIRS = """, pairs as (select snapshot_id, asset, fiat, case when json_valid(payload) then try_cast(json_extract_string(payload, '$."' || feed_id || '".' || lower(fiat)) as double) end as rate from raw_feeds, assets, fiats),
accepted as (select * from pairs where snapshot_id not in (select snapshot_id from pairs where rate is null))"""


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = feeds.parse_feeds(load(spark, sf_dir, "raw_feeds"))
    return rate_ops.normalise(raw)


@job(with_tables("raw_feeds", "assets", "fiats") + _PAIRS + " select snapshot_id, asset, fiat, rate from accepted")
def rate_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the snapshots that have all of them."""
    return accepted(spark, sf_dir).select("snapshot_id", "asset", "fiat", "rate")


@job(with_tables("raw_feeds", "assets", "fiats") + _PAIRS + """, placed as (select *, row_number() over (partition by snapshot_id order by asset_ordinal, fiat_ordinal) as place from accepted join assets using (asset) join fiats using (fiat))
select snapshot_id, cast(place as int) as place, asset, fiat, rate from placed""")
def rate_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON of each snapshot, read back: the place of each rate in the text must be that of the display order."""
    out = feeds.payloads(accepted(spark, sf_dir), load(spark, sf_dir, "assets"), load(spark, sf_dir, "fiats"))
    parsed = out.select("snapshot_id", F.from_json("payload", "rates map<string,map<string,double>>").alias("p"))
    assets = parsed.select("snapshot_id", F.posexplode("p.rates").alias("i", "asset", "prices"))
    fiats = assets.select("snapshot_id", "asset", "i", F.posexplode("prices").alias("j", "fiat", "rate"))
    return fiats.select("snapshot_id", (F.col("i") * 10 + F.col("j") + 1).alias("place"), "asset", "fiat", "rate")


AS_OF_SQL = with_tables("priced_events", "rate_ticks") + """
select e.event_id, e.asset, e.fiat, round(t.rate, 9) as rate, round((epoch_us(e.ts) - epoch_us(t.ts)) / 1e6, 6) as age_s, round(e.amount / t.rate, 6) as asset_amount
from priced_events e asof left join rate_ticks t on e.asset = t.asset and e.fiat = t.fiat and e.ts >= t.ts"""


def converted(found: DataFrame) -> DataFrame:
    """Events with the rate of their time -> its age and the amount in the asset."""
    age = (micros(F.col("ts")) - micros(F.col("tick_ts"))) / 1e6
    return found.select("event_id", "asset", "fiat", F.round("rate", 9).alias("rate"), F.round(age, 6).alias("age_s"), F.round(money.asset_amount(F.col("amount"), F.col("rate")), 6).alias("asset_amount"))


@job(AS_OF_SQL)
def rate_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events converted at the rate of their time."""
    return converted(rate_ops.as_of(load(spark, sf_dir, "priced_events"), load(spark, sf_dir, "rate_ticks"), ["asset", "fiat"]))


LATEST_SQL = with_tables("rate_ticks") + """, clock as (select max(ts) as now from rate_ticks), last as (select asset, fiat, arg_max(rate, ts) as rate, arg_max(stale, ts) as flagged, max(ts) as ts from rate_ticks group by asset, fiat)
select asset, fiat, round(rate, 9) as rate, round((epoch_us(now) - epoch_us(ts)) / 1e6, 6) as age_s, flagged or (epoch_us(now) - epoch_us(ts)) > 300000000 as stale, (epoch_us(now) - epoch_us(ts)) <= 300000000 as usable,
  case when (epoch_us(now) - epoch_us(ts)) // 1000000 < 60 then cast((epoch_us(now) - epoch_us(ts)) // 1000000 as varchar) || 's' else cast((epoch_us(now) - epoch_us(ts)) // 60000000 as varchar) || 'm' end as age_text
from last, clock"""


def described(last: DataFrame) -> DataFrame:
    """Latest rates with their age as text."""
    text = money.age_text(micros(F.col("ts")) / 1000, micros(F.col("now")) / 1000)
    return last.select("asset", "fiat", F.round("rate", 9).alias("rate"), F.round("age_s", 6).alias("age_s"), "stale", "usable", text.alias("age_text"))


@job(LATEST_SQL)
def rate_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rate of each asset and fiat, with its age at the newest tick of all."""
    return described(rate_ops.latest(load(spark, sf_dir, "rate_ticks"), F.max("ts")))


REPLAY_SQL = with_tables("rate_requests") + """, good as (select * from rate_requests where fetch_ok),
chain as (select instance_id, min(ts) as ts from good group by instance_id
  union all select c.instance_id, min(g.ts) as ts from chain c join good g on g.instance_id = c.instance_id and g.ts >= c.ts + interval 1 day group by c.instance_id),
links as (select g.instance_id, g.seq, g.ts from chain join good g using (instance_id, ts)),
marked as (select r.*, l.seq as link_seq, l.ts as link_ts from rate_requests r asof left join links l on r.instance_id = l.instance_id and r.ts >= l.ts)
select instance_id, seq, case when link_seq = seq then 'fetched' when link_seq is null then 'error' when ts < link_ts + interval 1 day then 'cached' else 'stale' end as status, link_seq as served_seq from marked"""


@job(REPLAY_SQL)
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of one day would have answered to each request."""
    return rate_ops.replay(load(spark, sf_dir, "rate_requests"), DAY_S)
