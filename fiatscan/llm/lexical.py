"""Ranked lexical search with variable-size block maxima.

Documents are dealt into shards as they are read. A shard holds, for each term that a query has, its posting list: documents (numbered inside the shard by length, so
that neighbours have like impacts) and impacts, the part of a score that does not depend on the query. Dynamic programming cuts each list into blocks
of up to `BLOCK` postings so that the summed error of bounding each impact by its block's maximum, plus one mean impact for each block, is least.

A query runs over a shard in two steps. The maxima of its terms' blocks, each over the block's range of documents, add up to a bound for every document.
Documents whose bound is below the tenth best score so far are skipped, and so are all blocks without another document: their
postings are not read. The rest are scored in full, so the result is exact. The best scores go along from shard to shard in a task, and a task hands on no
more than `top` rows a query. Where fewer than `top` are known yet, the documents of highest bounds are scored first.

score = sum over terms of w * ((SCALE * tf) div (1000 * tf + 8 * m)), m = 25 + (75 * n * N) div L, w = floor(1000 * ln((2N + 2) / (2df + 1))).

Only queries are sent to all tasks: at most `vocabulary` different terms of them, and at most `entries` pairs of query and term, at a time. Where queries
have more, they are taken in blocks (documents are read once a block of terms); a single query with more is a block of its own.

Null, empty and term-less texts are no documents here; null and term-less queries get no rows. Rows that repeat a doc_id or an item_id are documents and
queries of their own. Rows without doc_id come last among equal scores. Very long texts are read whole, in bounded runs. Empty tables give no rows. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ARROW_ROWS, setting, small_batches, stored
from .terms import fold_table, term_runs

TOP = 10
SCALE = 1_000_000_000
SHARD_DOCS = 16_384
SHARD_POSTINGS = 1_500_000
BLOCK = 64
SEED_DOCS = 32
VOCABULARY = 500_000
ENTRIES = 2_000_000
TERMS = fold_table(digits=True)
NO_ID = np.iinfo(np.int64).max
SHARD = "docs array<long>, sizes binary, terms array<int>, lengths array<int>, places binary, values binary"
INDEX = "docs array<long>, terms binary, lengths binary, places binary, values binary, block_sizes binary, block_tops binary"


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """q, text -> q, term, repeats."""
    for batch in batches:
        rows: list[tuple] = []
        for q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found: Counter = Counter()
            for run in term_runs(text, TERMS):
                found.update(run)
            rows += ((q, term, n) for term, n in found.items())
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64()))], ["q", "term", "repeats"])


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("q"), F.lit(blocks))


def block_count(entries: DataFrame, measure: Column, limit: int) -> int:
    """The number of hash blocks of queries with which none has a `measure` above the limit, unless it is a single query."""
    blocks = 1
    while entries.groupBy(block_of(blocks).alias("b")).agg(measure.alias("n"), F.min("q").alias("low"), F.max("q").alias("high")).where((F.col("n") > limit) & (F.col("low") < F.col("high"))).limit(1).count():
        blocks *= 2
    return blocks


def _shards(vocabulary, shard_docs: int, shard_postings: int):
    """doc_id, text -> shards: lengths of their documents, and postings by term, then place."""

    def shard(ids: list, sizes: list, terms: list, counts: list, held: list) -> pa.RecordBatch:
        n = np.array(sizes, np.int64)
        order = np.argsort(n, kind="stable")
        place = np.empty(len(n), np.int32)
        place[order] = np.arange(len(n), dtype=np.int32)
        term = np.array(terms, np.int32)
        at = np.repeat(place, held)
        by = np.lexsort((at, term))
        unique, lengths = np.unique(term, return_counts=True)
        row = [[ids[i] for i in order], n[order].tobytes(), unique.tolist(), lengths.tolist(), at[by].tobytes(), np.array(counts, np.int64)[by].tobytes()]
        types = (pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], ["docs", "sizes", "terms", "lengths", "places", "values"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        ids, sizes, terms, counts, held = [], [], [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: Counter = Counter()
                n = 0
                for run in term_runs(text, TERMS):
                    n += len(run)
                    found.update(map(number.get, run))
                if n:
                    found.pop(None, None)
                    ids.append(doc_id)
                    sizes.append(n)
                    terms += found.keys()
                    counts += found.values()
                    held.append(len(found))
                if len(ids) >= shard_docs or len(terms) >= shard_postings:
                    yield shard(ids, sizes, terms, counts, held)
                    ids, sizes, terms, counts, held = [], [], [], [], []
        if ids:
            yield shard(ids, sizes, terms, counts, held)

    return made


def cut_lists(values: np.ndarray, lengths: np.ndarray, most: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Lists laid one after another -> the sizes of the blocks of all of them, in order, and the number of blocks of each list.

    For each list, of all ways to cut it into blocks of at most `most`, one with the least sum over blocks of size * maximum + the list's mean value. All lists
    go forward together, a posting at a time: best[j] = min over the last block's start i of best[i] + (j - i) * max(i..j) + mean.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    price = np.array([values[s : s + n].sum() // n for s, n in zip(starts.tolist(), sizes.tolist())], np.int64)
    top = np.zeros((len(sizes), most), np.int64)  # by start modulo `most`: the maximum since then, and the best cost up to there
    base = np.full((len(sizes), most), np.iinfo(np.int64).max // 4)
    best = np.zeros(len(sizes), np.int64)
    back = np.empty(len(values), np.int32)
    columns = np.arange(most)
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
    for j, n in enumerate(live, 1):
        x = values[starts[:n] + j - 1].astype(np.int64)
        slot = (j - 1) % most
        base[:n, slot], top[:n, slot] = best[:n], 0
        np.maximum(top[:n], x[:, None], out=top[:n])
        long = (slot - columns) % most + 1
        cost = base[:n] + top[:n] * long
        pick = cost.argmin(axis=1)
        best[:n] = cost[np.arange(n), pick] + price[:n]
        back[starts[:n] + j - 1] = long[pick]
    left, first = lengths.copy(), np.cumsum(lengths) - lengths
    cuts = np.zeros(len(values), bool)
    while (open_ones := np.flatnonzero(left)).size:
        last = first[open_ones] + left[open_ones] - 1
        left[open_ones] -= back[last]
        cuts[first[open_ones] + left[open_ones]] = True
    begins = np.flatnonzero(cuts)
    return np.diff(np.append(begins, len(values))), np.diff(np.searchsorted(begins, np.append(first, len(values))))


def impacts(tf: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 25 + (75 * sizes * n_docs) // n_terms
    return (SCALE * tf) // (1000 * tf + 8 * m)


def _index(n_docs: int, n_terms: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                sizes, tf = (np.frombuffer(row[c].as_py(), np.int64) for c in ("sizes", "values"))
                places = np.frombuffer(row["places"].as_py(), np.int32)
                terms, lengths = (np.array(row[c].values, np.int64) for c in ("terms", "lengths"))
                values = impacts(tf, sizes[places], n_docs, n_terms).astype(np.int32)
                block_sizes, blocks = cut_lists(values, lengths)
                tops = np.maximum.reduceat(values, np.cumsum(block_sizes) - block_sizes) if len(values) else values
                parts = [terms.astype(np.int32), np.stack([lengths, blocks]).astype(np.int32), places, values, block_sizes.astype(np.int32), tops]
                yield pa.RecordBatch.from_arrays([pa.array([row["docs"].as_py()], pa.list_(pa.int64())), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], [c.split()[0] for c in INDEX.split(", ")])

    return made


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] places, then from starts[1], and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Shard:
    def __init__(self, docs: list, terms: np.ndarray, lengths: np.ndarray, blocks: np.ndarray, places: np.ndarray, values: np.ndarray, block_sizes: np.ndarray, tops: np.ndarray):
        self.docs = np.array([NO_ID if d is None else d for d in docs], np.int64)
        self.terms, self.places, self.values, self.tops = terms, places, values, tops.astype(np.int64)
        self.block_at = np.cumsum(blocks) - blocks
        self.blocks, self.block_sizes = blocks, block_sizes.astype(np.int64)
        self.block_start = np.cumsum(self.block_sizes) - self.block_sizes
        self.low = places[self.block_start] if len(places) else places
        self.high = places[self.block_start + self.block_sizes - 1] if len(places) else places
        self.read = 0  # postings scored

    @classmethod
    def of(cls, row: dict) -> Shard:
        terms, lengths, places, values, block_sizes, tops = (np.frombuffer(row[c], np.int32) for c in ("terms", "lengths", "places", "values", "block_sizes", "block_tops"))
        return cls(row["docs"], terms, *lengths.reshape(2, -1).astype(np.int64), places, values, block_sizes, tops)

    def scored(self, blocks: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Scores of the wanted documents (a mask) by place, from the blocks whose ranges hold one."""
        seen = np.concatenate([[0], np.cumsum(wanted)])
        use = seen[self.high[blocks] + 1] > seen[self.low[blocks]]
        blocks, weights = blocks[use], weights[use]
        at = spread(self.block_start[blocks], self.block_sizes[blocks])
        self.read += len(at)
        out = np.zeros(len(self.docs), np.int64)
        np.add.at(out, self.places[at], np.repeat(weights, self.block_sizes[blocks]) * self.values[at])
        return np.where(wanted, out, 0)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: np.ndarray, top: int) -> np.ndarray:
        """best: rows (score, doc_id), at most `top`, best first; the same after this shard. weights: w * repeats of each term."""
        slots = np.searchsorted(self.terms, terms)
        there = np.flatnonzero(self.terms[np.minimum(slots, len(self.terms) - 1)] == terms) if len(self.terms) else np.zeros(0, int)
        there = there[weights[there] > 0]
        if not len(there):
            return best
        slots = slots[there]
        blocks = spread(self.block_at[slots], self.blocks[slots])
        factor = np.repeat(weights[there], self.blocks[slots])
        step = np.zeros(len(self.docs) + 1, np.int64)
        np.add.at(step, self.low[blocks], factor * self.tops[blocks])
        np.subtract.at(step, self.high[blocks] + 1, factor * self.tops[blocks])
        bound = np.cumsum(step[:-1])
        floor = best[-1, 0] if len(best) == top else 1
        if len(best) < top and len(bound) > SEED_DOCS:
            seeds = np.zeros(len(bound), bool)
            seeds[np.argpartition(-bound, SEED_DOCS)[:SEED_DOCS]] = True
            first = self.scored(blocks, factor, seeds)[seeds]
            known = np.sort(np.concatenate([first[first > 0], best[:, 0]]))[::-1]
            floor = known[top - 1] if len(known) >= top else 1
        wanted = bound >= floor
        if not wanted.any():
            return best
        scores = self.scored(blocks, factor, wanted)
        hit = np.flatnonzero(scores >= floor)
        found = np.concatenate([best, np.stack([scores[hit], self.docs[hit]], 1)])
        return found[np.lexsort((found[:, 1], -found[:, 0]))[:top]]


def _search(queries, top: int):
    """Shards -> q, doc_id, score: the best of the task's shards for each query."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bounds, terms, weights = queries.value
        best = [np.zeros((0, 2), np.int64)] * len(keys)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.of(row)
                for k in range(len(keys)):
                    own = slice(bounds[k], bounds[k + 1])
                    best[k] = shard.search(terms[own], weights[own], best[k], top)
        sizes = [len(b) for b in best]
        rows = np.concatenate([np.zeros((0, 2), np.int64), *best])
        doc_ids = pa.array(rows[:, 1], mask=rows[:, 1] == NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, sizes)), doc_ids, pa.array(rows[:, 0])], ["q", "doc_id", "score"])

    return made


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def build_index(docs: DataFrame, vocabulary: list[bytes], shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> tuple[DataFrame, list[int]]:
    """The stored shards of the vocabulary's terms, with their blocks, and each term's weight. vocabulary: a bounded number of terms."""
    spark = docs.sparkSession
    number = spark.sparkContext.broadcast({term: k for k, term in enumerate(vocabulary)})
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).where("text is not null")
    shards = stored(rows.mapInArrow(_shards(number, shard_docs, shard_postings), SHARD), "shards")
    with setting(spark, ARROW_ROWS, "1"):  # a shard is a row of some megabytes
        sizes = shards.select("docs", "sizes").mapInArrow(_totals, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
        n_docs, n_terms = (int(x or 0) for x in sizes)
        held = shards.select(F.explode(F.arrays_zip("terms", "lengths")).alias("t")).groupBy("t.terms").agg(F.sum("t.lengths").alias("df"))
        df = {r["terms"]: r["df"] for r in held.collect()}  # no more rows than the vocabulary has terms
        index = stored(shards.mapInArrow(_index(n_docs, n_terms), INDEX), "index")
    return index, [weight(n_docs, df.get(k, 0)) for k in range(len(vocabulary))]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [np.frombuffer(x, np.int64) for x in batch.column("sizes").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sizes], pa.int64()), pa.array([int(s.sum()) for s in sizes], pa.int64())], ["n_docs", "n_terms"])


def search(docs: DataFrame, items: DataFrame, top: int = TOP, vocabulary: int = VOCABULARY, entries: int = ENTRIES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """documents, benchmark -> item_id, rank, doc_id, score: the `top` documents of highest score above 0 of each item."""
    spark = docs.sparkSession
    small_batches(spark, 1000)
    asked = stored(items.select("item_id", F.col("text").cast("binary").alias("text")).withColumn("q", F.monotonically_increasing_id()), "queries")
    terms = stored(asked.where("text is not null").select("q", "text").mapInArrow(_query_terms, "q long, term binary, repeats long"), "query-terms")
    n_blocks = block_count(terms, F.count_distinct("term"), vocabulary)
    found: DataFrame | None = None
    for k in range(n_blocks):
        own = terms.where(block_of(n_blocks) == k)
        words = [bytes(r["term"]) for r in own.select("term").distinct().orderBy("term").collect()]  # at most `vocabulary`
        if not words:
            continue
        index, weights = build_index(docs, words, shard_docs)
        number = {term: i for i, term in enumerate(words)}
        n_parts = block_count(own, F.count("*"), entries)
        for part in range(n_parts):
            rows = own.where(block_of(n_parts) == part).orderBy("q", "term").collect()  # at most `entries`
            keys, firsts = np.unique([r["q"] for r in rows], return_index=True)
            numbers = np.array([number[bytes(r["term"])] for r in rows], np.int64)
            factors = np.array([weights[i] * r["repeats"] for i, r in zip(numbers.tolist(), rows)], np.int64)
            shared = spark.sparkContext.broadcast((keys, np.append(firsts, len(rows)), numbers, factors))
            with setting(spark, ARROW_ROWS, "1"):
                best = stored(index.mapInArrow(_search(shared, top), "q long, doc_id long, score long"), "best")
            found = best if found is None else found.unionAll(best)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").select(F.col("item_id").cast(items.schema["item_id"].dataType).alias("item_id"), "rank", "doc_id", "score")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def oracle_sql(top: int = TOP) -> str:
    """The query's result in DuckDB SQL."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as (select rid, doc_id, w, len(w) as n from (select row_number() over () as rid, doc_id, {words} as w from documents) x where len(w) > 0),
z as (select count(*) as docs, sum(n) as terms from d),
qt as (select qid, item_id, term, count(*) as reps from (select qid, item_id, unnest(w) as term from (select row_number() over () as qid, item_id, {words} as w from benchmark) x) y group by qid, item_id, term),
tf as (select rid, doc_id, n, term, count(*) as tf from (select rid, doc_id, n, unnest(w) as term from d) x where term in (select term from qt) group by rid, doc_id, n, term),
df as (select term, cast(floor(1000 * ln(cast(2 * max(docs) + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from tf cross join z group by term),
s as (select qid, item_id, rid, doc_id, sum(reps * df.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) as score from qt join tf using (term) join df using (term) cross join z group by qid, item_id, rid, doc_id),
r as (select *, row_number() over (partition by qid order by score desc, doc_id nulls last) as place from s where score > 0)
select item_id, cast(place as integer) as rank, doc_id, cast(score as bigint) as score from r where place <= {top}"""
