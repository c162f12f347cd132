"""Hilbert-curve sharding with DataFrame functions only.

Several metadata dimensions are quantised to cells of a grid, the rows are put in the order of the
Hilbert curve through the grid, and the order is cut into runs of equal row counts. Rows near each
other on the curve are near in every dimension, so each run covers a small box: `zone_map` gives the
box of each shard, by which a reader prunes files on any of the dimensions. A category's cell follows the order of its values, cut so that
cells have near equal row counts; so a shard's least and greatest source or language lie close, and a filter on either skips shards.

The order is never sorted as a whole. The at most `2 ** (dims * bits)` cells are counted. Inside a cell rows follow a hash of
their own, cut into so many ranges that each has up to about `GROUP_ROWS` rows; these are counted too, and a row's rank is the sum of what comes before its
cell, before its range and before itself in the range. So a cell that holds a third of all rows is
spread over its ranges, and how many ranges there are changes no row's place.

Nulls: a dimension that is null comes first in its order; a null text has one byte and the
checksum of no bytes. Repeated rows get different slots. An empty table gives no rows. Very long texts count by their bytes; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BITS = 4
GROUP_ROWS = 1024
TIE_BITS = 60
BROADCAST_VALUES = 100_000


def _curve_tables(dims: int) -> tuple[list[int], list[int], list[int]]:
    """For each corner of a cube on the Gray-code path: its rank, and the entry point and direction of the rank's subcube."""
    size = 1 << dims
    rank = [0] * size
    for i in range(size):
        rank[i ^ (i >> 1)] = i
    entry, direction = [0], [0]
    for i in range(1, size):
        even = 2 * ((i - 1) // 2)
        entry.append(even ^ (even >> 1))
        odd = i if i & 1 else i - 1
        direction.append((((odd + 1) & -(odd + 1)).bit_length() - 1) % dims)
    return rank, entry, direction


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of the grid point with these coordinates, each an int of `bits` bits."""
    dims = len(cells)
    mask = (1 << dims) - 1
    rank, entry, direction = (F.array(*map(F.lit, t)) for t in _curve_tables(dims))
    shifted = [c.cast("int") for c in cells]

    def rotl(x: Column, n: Column) -> Column:
        n = F.pmod(n, F.lit(dims))
        return F.call_function("shiftleft", x, n).bitwiseOR(F.call_function("shiftright", x, F.lit(dims) - n)).bitwiseAND(F.lit(mask))

    def step(state: Column, corner: Column) -> Column:
        turned = rotl(corner.bitwiseXOR(state["e"]), F.lit(dims) - state["d"] - 1)
        w = F.element_at(rank, turned + 1)
        return F.struct(
            (state["h"] * (1 << dims) + w).alias("h"),
            state["e"].bitwiseXOR(rotl(F.element_at(entry, w + 1), state["d"] + 1)).alias("e"),
            F.pmod(state["d"] + F.element_at(direction, w + 1) + 1, F.lit(dims)).alias("d"),
        )

    def corner(level: int) -> Column:
        out = F.lit(0)
        for i, c in enumerate(shifted):
            bit = F.shiftright(c, level).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, i))
        return out

    start = F.struct(F.lit(0).alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.array(*(corner(level) for level in reversed(range(bits)))), start, step, lambda s: s["h"])


def with_category_cell(rows: DataFrame, column: str, cell: str, bits: int = BITS) -> DataFrame:
    """`rows` with `cell`: the place of the category among all rows in the order of the values, in `2 ** bits` parts of near equal size.

    Counted by value first, so the order is found over distinct values, range by range; they are broadcast only up to BROADCAST_VALUES of them, and beyond that joined.
    """
    value = F.struct(F.col(column).isNotNull().alias("known"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value"))
    keyed = rows.withColumn("_value", value)
    # Ranges of values first: the order within each, then the order of the ranges, so that no task holds all values.
    counts = stored(keyed.groupBy("_value").agg(F.count("*").alias("_n")).repartitionByRange("_value").withColumn("_range", F.spark_partition_id()), "value-counts")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = counts.groupBy("_range").agg(F.sum("_n").alias("_m")).select("_range", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_start"), F.sum("_m").over(whole).alias("_total"))
    inside = Window.partitionBy("_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    cells = stored(counts.join(ranges, "_range").withColumn("_before", before).select("_value", F.expr(f"cast(_before * {1 << bits} div _total as int)").alias(cell)), "cells")
    few = cells.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
    return keyed.join(F.broadcast(cells) if few else cells, "_value").drop("_value")


def quantise_size(column: Column, bits: int = BITS) -> Column:
    """A cell by order of magnitude: one for each doubling, the last for all above."""
    return F.coalesce(F.least(F.length(F.bin(F.greatest(column, F.lit(1)))) - 1, F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def row_hash(*columns: str) -> Column:
    """TIE_BITS bits of the md5 of the columns as text, nulls left out, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns).cast("binary")), 1, TIE_BITS // 4), 16, 10).cast("long")


def hilbert_shards(rows: DataFrame, cells: list[Column], tie: Column, n_shards: int, bits: int = BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`rows` with `curve` (place of the row's cell), `shard` (0 to n_shards - 1, row counts at most one apart) and `slot` (gapless from 0).

    `tie`, a hash of TIE_BITS bits, orders the rows of a cell; equal hashes follow the columns of `rows`. Rows are stored once, so give only
    the columns that the result needs.
    """
    placed = stored(rows.withColumns({"curve": hilbert_index(cells, bits), "_tie": tie}), "hilbert")
    order = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_cell = placed.groupBy("curve").agg(F.count("*").alias("_n"))
    outer = per_cell.select("curve", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("_total"), F.expr(f"length(bin(_n div {group_rows}))").alias("_bits"))
    placed = placed.join(stored(outer, "curves"), "curve").withColumn("_bucket", F.expr(f"shiftright(_tie, {TIE_BITS} - _bits)"))
    in_cell = Window.partitionBy("curve").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("curve", "_bucket").agg(F.count("*").alias("_n")).select("curve", "_bucket", F.coalesce(F.sum("_n").over(in_cell), F.lit(0)).alias("_before"))
    place = Window.partitionBy("curve", "_bucket").orderBy("_tie", *[c for c in rows.columns])
    ranked = placed.withColumn("_place", F.row_number().over(place) - 1).join(offsets, ["curve", "_bucket"])
    return (
        ranked.withColumn("_rank", F.col("_start") + F.col("_before") + F.col("_place"))
        .withColumn("shard", F.expr(f"_rank * {n_shards} div _total").cast("int"))
        .withColumn("slot", F.expr(f"_rank - (shard * _total + {n_shards - 1}) div {n_shards}").cast("long"))
        .select(*rows.columns, "curve", "shard", "slot")
    )


def zone_map(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Per shard: row count, and least and greatest value of each column, for pruning whole shards."""
    bounds = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *bounds)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in curve order inside each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """documents -> doc_id, size, text_crc32, law, shard, slot, grown_shard, source, lang, the three cells and the curve's place.

    Dimensions: source, language and order of magnitude of the size. The law is `rows`.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "source", "lang")
    rows = with_category_cell(with_category_cell(stored(rows, "sized"), "source", "source_cell"), "lang", "lang_cell").withColumn("size_cell", quantise_size(F.col("size")))
    tie = row_hash("doc_id", "text_crc32", "size")
    out = hilbert_shards(rows, [F.col("source_cell"), F.col("lang_cell"), F.col("size_cell")], tie, n_shards)
    columns = ["shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "lang", "source_cell", "lang_cell", "size_cell", "curve"]
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), *columns)


def oracle_sql(n_shards: int = 8) -> str:
    """DuckDB SQL of `shard_documents`: one sort of all rows, checksums byte by byte, and the curve walked down level by level for each cell."""
    turn = lambda x, n: f"((({x}) << ((({n}) % 3 + 3) % 3)) | (({x}) >> (3 - ((({n}) % 3 + 3) % 3)))) & 7"
    corner = "((a >> (l - 1)) & 1) | (((b >> (l - 1)) & 1) << 1) | (((c >> (l - 1)) & 1) << 2)"
    return f"""
with recursive poly as (select 0 as k, i as b, cast(i as bigint) as v from range(256) t(i) union all select k + 1, b, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from poly where k < 8),
tab as (select list(v order by b) as t from poly where k = 8),
bytes as (select doc_id, source, lang, row_number() over () as rid, coalesce(strlen(text), 0) + 1 as size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: cast('0x' || h as bigint)) as body from documents),
sized as (select doc_id, source, lang, cast(size as bigint) as size, xor(list_reduce(list_prepend(cast(4294967295 as bigint), body), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295) as text_crc32 from bytes, tab),
part as (select source, cast(16 * coalesce(sum(n) over (order by source nulls first rows between unbounded preceding and 1 preceding), 0) // sum(n) over () as int) as source_cell from (select source, count(*) as n from sized group by source) x),
tongue as (select lang, cast(16 * coalesce(sum(n) over (order by lang nulls first rows between unbounded preceding and 1 preceding), 0) // sum(n) over () as int) as lang_cell from (select lang, count(*) as n from sized group by lang) x),
placed as (select s.*, source_cell, lang_cell, cast(least(length(bin(size)) - 1, 15) as int) as size_cell from sized s join part p on s.source is not distinct from p.source join tongue g on s.lang is not distinct from g.lang),
gray as (select w, xor(w, w >> 1) as corner from range(8) t(w)),
path as (select w, corner, case when w = 0 then 0 else xor(2 * ((w - 1) // 2), (2 * ((w - 1) // 2)) >> 1) end as entry, [0, 1, 1, 2, 2, 1, 1, 0][w + 1] as direction from gray),
walk as (select distinct source_cell as a, lang_cell as b, size_cell as c, {BITS} as l, 0::bigint as h, 0::bigint as e, 0::bigint as d from placed
  union all select a, b, c, l - 1, h * 8 + w, xor(e, {turn("entry", "d + 1")}), (d + direction + 1) % 3 from walk, path where corner = {turn(f"xor({corner}, e)", "2 - d")} and l > 0),
curves as (select a as source_cell, b as lang_cell, c as size_cell, cast(h as int) as curve from walk where l = 0),
ranked as (select *, row_number() over (order by curve, substr(md5(concat_ws('|', doc_id, text_crc32, size)), 1, {TIE_BITS // 4}), doc_id nulls first, size, text_crc32, source nulls first, lang nulls first) - 1 as r, count(*) over () as n from placed join curves using (source_cell, lang_cell, size_cell)),
cut as (select *, r * {n_shards} // n as shard from ranked)
select doc_id, size, text_crc32, 'rows' as law, cast(shard as int) as shard, cast(r - (shard * n + {n_shards - 1}) // {n_shards} as bigint) as slot, cast(null as int) as grown_shard, source, lang, source_cell, lang_cell, size_cell, curve from cut"""
