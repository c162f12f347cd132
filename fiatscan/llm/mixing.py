"""Mixing sources to target weights by hierarchical budgeting.

The leaves of a tree (domain, language, source) hold token counts. A token budget goes down the tree: the children of a
node share its budget by weight, a child that cannot use its share (its tokens times `max_epochs`) is
filled, and what it leaves goes to its siblings by weight. Only when all children of a node are full is
the node short of its own share, and then its siblings take the rest; so shortages are made good among
siblings before ancestors. Shares are whole tokens, rounding goes to the first siblings by name.

A leaf with a share of A tokens and N at hand takes A div N whole epochs and, in the seeded order of
the next epoch, the first documents up to A mod N tokens, the last of them in part. The order is that of a hash, so
prefix sums are taken over ranges of the hash: totals of ranges, then rows inside one range. The hash is of seed, epoch, doc_id and text, so a leaf with a third
of all rows, without ids or with one id for all, is spread over thousands of ranges; only rows of equal id and text stay together.

A token is a run of characters that are not ASCII white space. Null levels are named ''. A null or
empty text has no tokens and takes none. Rows that repeat a doc_id are counted each; those that repeat its text too are alike, whichever comes first. A weight of 0, or
an empty table, takes nothing. Very long texts are counted whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEVELS = ("domain", "lang", "source")
#: By level and name; 1 for any other.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {}}
SEED = "mix-1"
MAX_EPOCHS = 2
BUDGET_PERCENT = 60
RANGE_DIGITS = 3
TOKEN = "[^\\x20\\x09-\\x0D]+"


def domain_of(source: Column) -> Column:
    """The domain of a source: by the number in its name, modulo 4."""
    number = F.regexp_extract(source, "([0-9]+)", 1).try_cast("long")
    return F.concat(F.lit("d"), F.coalesce(number % 4, F.lit(0)).cast("string"))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, weight).otherwise(out)
    return out.cast("long")


def allocate(leaves: DataFrame, budget: Column, levels: tuple[str, ...] = LEVELS, weights: dict | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves (levels, tokens) -> levels, tokens, share. `budget` is an aggregate over leaves, such as lit(10**9)."""
    weights = WEIGHTS if weights is None else weights
    whole = lambda c: c.cast("decimal(20,0)")
    given = leaves.agg(budget.cast("long").alias("share"))
    above: list[str] = []
    for level in levels:
        here = [*above, level]
        nodes = leaves.groupBy(*here).agg((F.sum("tokens") * max_epochs).cast("long").alias("cap")).withColumn("w", _weight(level, weights))
        nodes = nodes.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0))
        nodes = nodes.join(given, above) if above else nodes.crossJoin(F.broadcast(given))
        family = Window.partitionBy(*above)
        by_need = family.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(0.0), level)
        before = by_need.rowsBetween(Window.unboundedPreceding, -1)
        onward = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        nodes = nodes.withColumn("share", F.least("share", F.sum("cap").over(family)))
        nodes = nodes.withColumns({"filled": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_left": F.sum("w").over(onward)})
        nodes = nodes.withColumn("full", whole(F.col("cap")) * whole(F.col("w_left")) <= whole(F.col("share") - F.col("filled")) * whole(F.col("w")))
        nodes = nodes.withColumns({"left": F.col("share") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family), "w_open": F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(family)})
        nodes = nodes.withColumn("_product", whole(F.col("left")) * whole(F.col("w"))).withColumn("_open", whole(F.greatest("w_open", F.lit(1))))
        nodes = nodes.withColumn("part", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("_product div _open")))
        nodes = nodes.withColumn("odd", F.col("left") - F.sum(F.when(~F.col("full"), F.col("part")).otherwise(0)).over(family))
        turn = F.sum(F.when(~F.col("full") & (F.col("w") > 0), 1).otherwise(0)).over(family.orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        extra = F.when(~F.col("full") & (F.col("w") > 0) & (turn <= F.col("odd")), 1).otherwise(0)
        given = nodes.select(*here, (F.col("part") + extra).cast("long").alias("share"))
        above = here
    return leaves.join(given, list(levels)).select(*levels, "tokens", "share")


def select(rows: DataFrame, shares: DataFrame, levels: tuple[str, ...] = LEVELS, seed: str = SEED) -> DataFrame:
    """rows (doc_id, levels, n_tokens, text_md5, ...), shares -> rows with full_epochs, partial_tokens, taken."""
    shares = stored(shares.select(*levels, F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(0).alias("full_epochs"), F.when(F.col("tokens") > 0, F.expr("share % tokens")).otherwise(0).alias("_rest")), "shares")
    order = F.md5(F.concat(F.lit(seed + "-"), F.col("full_epochs").cast("string"), F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("-"), F.col("text_md5")).cast("binary"))
    keyed = stored(rows.join(shares, list(levels)).withColumn("_order", order).withColumn("_range", F.substring("_order", 1, RANGE_DIGITS)), "mixed")
    ranges = keyed.groupBy(*levels, "_range").agg(F.sum("n_tokens").alias("_sum"))
    earlier = Window.partitionBy(*levels).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*levels, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*levels, "_range").orderBy("_order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(ranges, [*levels, "_range"])
    partial = F.least(F.col("n_tokens"), F.greatest(F.lit(0), F.col("_rest") - F.col("_base") - F.col("_in"))).cast("long")
    out = placed.withColumn("partial_tokens", partial)
    return out.select(*rows.columns, "full_epochs", "partial_tokens", (F.col("full_epochs") * F.col("n_tokens") + F.col("partial_tokens")).alias("taken"))


def mix(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, weights: dict | None = None, seed: str = SEED) -> DataFrame:
    """documents -> doc_id, domain, lang, source, n_tokens, full_epochs, partial_tokens, taken, text_hash (names the row's text)."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source"), token_count(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("text_hash"), F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_md5"))
    rows = stored(rows.withColumn("domain", domain_of(F.col("source"))), "counted")
    leaves = stored(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    budget = F.expr(f"coalesce(sum(tokens), 0) * {int(budget_percent)} div 100")
    return select(rows, allocate(leaves, budget, weights=weights, max_epochs=max_epochs), seed=seed).select("doc_id", *LEVELS, "n_tokens", "full_epochs", "partial_tokens", "taken", "text_hash")


def oracle_sql(budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> str:
    """The query's result in DuckDB SQL."""
    parts, above = [], []
    for level in LEVELS:
        here = [*above, level]
        cases = " ".join(f"when {level} = '{n}' then {w}" for n, w in WEIGHTS[level].items())
        weight = f"case {cases} else 1 end" if cases else "1"
        family = f"partition by {', '.join(above)}" if above else ""
        keys = ", ".join(here)
        source = f"join g_{above[-1]} using ({', '.join(above)})" if above else "cross join g_root"
        parts.append(f"""
n_{level} as (select {keys}, cap, {weight} as w, share from (select {keys}, cast(sum(tokens) * {max_epochs} as bigint) as cap from leaves group by {keys}) {source}),
a_{level} as (select {keys}, cap, w, least(share, sum(cap) over ({family})) as share,
  coalesce(sum(cap) over ({family} order by cap * 1.0e0 / w, {level} rows between unbounded preceding and 1 preceding), 0) as filled,
  sum(w) over ({family} order by cap * 1.0e0 / w, {level} rows between current row and unbounded following) as w_left from n_{level}),
b_{level} as (select *, cap::hugeint * w_left <= (share - filled)::hugeint * w as is_full from a_{level}),
c_{level} as (select *, share - sum(case when is_full then cap else 0 end) over ({family}) as rest, sum(case when is_full then 0 else w end) over ({family}) as w_open from b_{level}),
d_{level} as (select *, case when is_full then cap else (rest::hugeint * w) // greatest(w_open, 1) end as part from c_{level}),
e_{level} as (select *, rest - sum(case when is_full then 0 else part end) over ({family}) as odd,
  sum(case when is_full then 0 else 1 end) over ({family} order by {level} rows between unbounded preceding and current row) as turn from d_{level}),
g_{level} as (select {keys}, cast(part + case when not is_full and turn <= odd then 1 else 0 end as bigint) as share from e_{level})""")
        above = here
    keys = ", ".join(LEVELS)
    return f"""
with counted as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    'd' || cast(coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)', 1) as bigint) % 4, 0) as varchar) as domain,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as n_tokens, md5(coalesce(text, '')) as text_md5
  from documents),
leaves as (select {keys}, sum(n_tokens) as tokens from counted group by {keys}),
g_root as (select cast(coalesce(sum(tokens), 0) * {budget_percent} // 100 as bigint) as share from leaves),
{",".join(parts)},
shares as (select {keys}, case when tokens > 0 then share // tokens else 0 end as full_epochs, case when tokens > 0 then share % tokens else 0 end as rest from leaves join g_source using ({keys})),
keyed as (select *, md5('{seed}-' || cast(full_epochs as varchar) || '-' || coalesce(cast(doc_id as varchar), '') || '-' || text_md5) as o from counted join shares using ({keys})),
placed as (select *, coalesce(sum(n_tokens) over (partition by {keys} order by o, doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) as before from keyed),
done as (select *, least(n_tokens, greatest(0, rest - before)) as partial_tokens from placed)
select doc_id, domain, lang, source, cast(n_tokens as bigint) as n_tokens, cast(full_epochs as bigint) as full_epochs,
  cast(partial_tokens as bigint) as partial_tokens, cast(full_epochs * n_tokens + partial_tokens as bigint) as taken
from done"""
