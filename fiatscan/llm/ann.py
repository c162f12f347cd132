"""Nearest neighbours by inner product with multi-index hashing.

Vectors get binary codes: signs after rotations learned on a bounded sample, each by alternating between
codes and the rotation nearest to them. An extra coordinate makes all norms equal, so that a near code means a large
inner product. A code is split into substrings, each of which has an index: a table from the substring's
value to the vectors that have it. A value has about sixteen vectors or more.

A query probes every index within one bit of its own value. Two codes within Hamming radius
`2 * substrings - 1` differ by at most one bit in some substring, so by the pigeonhole principle these probes find every code in that
radius. Where neighbours lie farther, as in data without clusters, each index is probed on, at the values that flip the
bits of least margin. How wide and how many (at least `LEAST_SUBSTRINGS`) the substrings are and how many values are probed is learned: of the ways that find a share `COVERAGE` of the
20 nearest of 256 vectors, which are compared with all others for this, the one that costs least is taken. What counts is rows made for the indices and for probes, comparisons with rows
met, and pairs handed on, as often as an index has them; wide substrings ask for many probes, narrow ones meet many rows. Index and probes are
joined on (substring, value) and by nothing else; pairs beyond a Hamming radius of the whole codes, learned likewise, are dropped in that
join, and what is left is ranked by the inner product in double precision.

A query whose probes find fewer vectors than are wanted (an odd one, or a small table) is compared with all vectors, so none is
left short. Equal vectors are one class with its smallest ids, as many as an answer can need; their ids are
taken over salted groups. All vectors are in the indices, and no value's list is cut; a value that many vectors share is split
by the skew handling of Spark's joins. For the ranking, candidates are dealt to the blocks of vectors that hold them; a task
holds one block and streams the queries past it.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do rows
without vec_id. Rows that repeat are one. Of equal scores the smaller vec_id comes first. With fewer candidates than asked for, all
are returned. An empty table, or one without a query, gives no rows. Other columns, whatever their names, are ignored; vectors of any
length and tables of any size are handled alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

BITS = 256
VALUE_BITS = 4  # a value of a substring has about 2 ** VALUE_BITS vectors, or more
LEAST_WIDTH, MOST_WIDTH = 4, 24
PATTERNS = 4096
FLIP_ROWS = 1024
SAMPLE = 4096
SAMPLE_QUERIES = 256
ROUNDS = 25
COVERAGE = 0.985
LEAST_SUBSTRINGS = 4
BLOCK = 8192
SALTS = 64
TOP = 20
EVERY = 20
# Costs in the join of index and probes, where a row made for an index or a probe (dealt, sorted) costs 1; measured: 0.016, 1.25 and 0.83 microseconds.
COMPARED = 0.02  # of comparing the codes of a query and of a row that it meets
KEPT = 1.5  # of handing on a pair within the radius
WORSE = 4  # widths, or numbers of substrings of a width, in turn that cost more than the best so far end the search


@dataclass
class Coder:
    mean: np.ndarray
    planes: np.ndarray  # (dims + 1, bits)
    norm: float
    width: int  # bits of a substring
    substrings: int  # as many have an index
    probes: int  # values probed in each index
    radius: int  # Hamming radius of the whole codes


def projected(x: np.ndarray, coder: Coder) -> np.ndarray:
    """Distances to the planes of vectors, brought to the common norm by an extra coordinate."""
    extra = np.sqrt(np.maximum(0.0, coder.norm**2 - (x * x).sum(1)))
    return (np.c_[x, extra] - coder.mean) @ coder.planes


def projected_queries(x: np.ndarray, coder: Coder) -> np.ndarray:
    """The same of queries, whose length does not change the order of inner products."""
    scaled = x * (coder.norm / np.sqrt((x * x).sum(1)))[:, None]
    return (np.c_[scaled, np.zeros(len(x))] - coder.mean) @ coder.planes


def words(sides: np.ndarray) -> np.ndarray:
    """Whole codes as 64-bit words."""
    return np.packbits(sides > 0, axis=1).view(np.uint64)


def values(sides: np.ndarray, coder: Coder) -> np.ndarray:
    """Value of each substring."""
    bits = (sides > 0)[:, : coder.substrings * coder.width].reshape(len(sides), coder.substrings, coder.width)
    return bits @ (1 << np.arange(coder.width))


def flips(width: int) -> np.ndarray:
    """Sets of bits of a substring, fewest first: none, each one, then more of them together, while they are at most PATTERNS."""
    out = [()]
    for n in range(1, width + 1):
        more = list(combinations(range(width), n))
        if n > 1 and len(out) + len(more) > PATTERNS:
            break
        out += more
    return np.array([[k in p for k in range(width)] for p in out])


def flip_order(sides: np.ndarray, probes: int, patterns: np.ndarray) -> np.ndarray:
    """Per row of plane distances of one substring, places of patterns: none and single bits, then those of least margin, `probes` in all."""
    margins = (sides * sides).astype(np.float32)
    out = np.empty((len(margins), min(probes, len(patterns))), np.int32)
    ball = sides.shape[1] + 1
    out[:, :ball] = np.arange(ball)[: out.shape[1]]
    if (extra := out.shape[1] - ball) > 0:
        weights = patterns[ball:].T.astype(np.float32)
        for start in range(0, len(margins), FLIP_ROWS):
            cost = margins[start : start + FLIP_ROWS] @ weights
            least = np.argpartition(cost, extra - 1, axis=1)[:, :extra]
            out[start : start + FLIP_ROWS, ball:] = ball + np.take_along_axis(least, np.argsort(np.take_along_axis(cost, least, 1), axis=1, kind="stable"), 1)
    return out


def probe_values(sides: np.ndarray, coder: Coder) -> np.ndarray:
    """(query, substring, probe): the values to look up in each index."""
    patterns = flips(coder.width)
    masks = patterns @ (1 << np.arange(coder.width))
    order = flip_order(sides[:, : coder.substrings * coder.width].reshape(-1, coder.width), coder.probes, patterns)
    return values(sides, coder)[:, :, None] ^ masks[order].reshape(len(sides), coder.substrings, -1)


def tried(asking: np.ndarray, held: np.ndarray, near: np.ndarray, coder: Coder) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For one, two, ... substrings: per query and each of its `near` the number of probes of each index that find it (the number of patterns where none does),
    and per number of probes the mean number of held vectors that a query's probes meet in those indices, and of these within the radius."""
    patterns = flips(coder.width)
    masks = patterns @ (1 << np.arange(coder.width))
    known = np.argsort(masks)
    own, theirs, wanted = values(asking, coder), values(held, coder), values(near.reshape(-1, near.shape[2]), coder).reshape(*near.shape[:2], -1)
    first, met, kept = np.full(near.shape[:2], len(patterns), np.int32), np.zeros(len(patterns)), np.zeros(len(patterns))
    q, c = np.nonzero(np.bitwise_count(words(asking)[:, None, :] ^ words(held)).sum(2) <= coder.radius)
    for k in range(coder.substrings):
        order = flip_order(asking[:, k * coder.width : (k + 1) * coder.width], len(patterns), patterns)
        turn = np.empty_like(order)
        np.put_along_axis(turn, order, np.broadcast_to(np.arange(len(patterns), dtype=np.int32), order.shape), 1)
        turn = np.c_[turn, np.full(len(turn), len(patterns), np.int32)]  # of a value without a pattern
        place = lambda changed: np.where(masks[at := known[np.minimum(np.searchsorted(masks, changed, sorter=known), len(masks) - 1)]] == changed, at, len(masks))
        first = np.minimum(first, np.take_along_axis(turn, place(own[:, k, None] ^ wanted[:, :, k]), 1))
        kept = kept + np.bincount(turn[q, place(own[q, k] ^ theirs[c, k])], minlength=len(patterns) + 1)[:-1].cumsum() / len(asking)
        seen, n = np.unique(theirs[:, k], return_counts=True)
        looked = own[:, k, None] ^ masks[order]
        at = np.minimum(np.searchsorted(seen, looked), len(seen) - 1)
        met = met + np.where(seen[at] == looked, n[at], 0).mean(axis=0).cumsum()
        yield first, met, kept


def ways(asking: np.ndarray, held: np.ndarray, near: np.ndarray, coder: Coder, coverage: float, total: int, share: float) -> Iterator[tuple[float, int, int, int]]:
    """Cost of a query, width, substrings and probes of each way that finds the share `coverage` of `near` by indices of the coder's width: its probes' rows, its
    part of the indices' rows, comparisons with all rows met, and pairs handed on, of `total` vectors."""
    n_patterns = len(flips(coder.width))
    least, at = np.inf, LEAST_SUBSTRINGS
    for k, (first, met, kept) in enumerate(tried(asking, held, near, coder), 1):
        need = int(np.quantile(first, coverage, method="higher"))
        if k >= min(LEAST_SUBSTRINGS, coder.substrings) and need < n_patterns:
            need = min(max(coder.width, need) + 1, n_patterns)
            cost = k * (need + 1 / share) + (COMPARED * met[need - 1] + KEPT * kept[need - 1]) * total / len(held)
            yield cost, coder.width, k, need
            least, at = min((least, at), (cost, k))
            if at <= k - WORSE:
                return


def learn(sample: np.ndarray, norm: float, total: int, bits: int = BITS, seed: int = 0, coverage: float = COVERAGE, share: float = 1 / EVERY, near: tuple[np.ndarray, np.ndarray] | None = None) -> Coder:
    """total: vectors in all; share: of them that are queries; near: some vectors, and the nearest of all to each. Without these, the sample's nearest stand for the nearest of all."""
    rng = np.random.default_rng(seed)
    coder = Coder(np.zeros(sample.shape[1] + 1), np.eye(sample.shape[1] + 1), norm, 1, 1, 1, bits)
    lifted = projected(sample, coder)
    mean = lifted.mean(0)
    x = lifted - mean
    width = min(sample.shape[1], bits)
    _, _, axes = np.linalg.svd(x.T @ x)
    axes = axes[:width].T
    low = x @ axes
    planes = []
    while sum(p.shape[1] for p in planes) < bits:
        turn, _ = np.linalg.qr(rng.normal(size=(width, width)))
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(low.T @ np.sign(low @ turn))
            turn = u @ v
        planes.append(axes @ turn)
    coder = Coder(mean, np.concatenate(planes, 1)[:, :bits], norm, LEAST_WIDTH, bits // LEAST_WIDTH, 1, bits)
    if near is None:
        at = rng.permutation(len(sample))[:SAMPLE_QUERIES]
        scores = sample[at] @ sample.T
        scores[np.arange(len(at)), at] = -np.inf
        n_near = max(1, min(len(sample) - 1, round(TOP * len(sample) / max(total, 1))))
        best = np.argpartition(-scores, n_near - 1, axis=1)[:, :n_near] if len(sample) > 1 else np.zeros((len(at), 1), int)
        near = sample[at], sample[best]
    asking, held = projected_queries(near[0], coder), projected(sample, coder)
    wanted = projected(near[1].reshape(-1, sample.shape[1]), coder).reshape(*near[1].shape[:2], -1)
    apart = np.bitwise_count(words(asking)[:, None, :] ^ words(wanted.reshape(-1, bits)).reshape(*wanted.shape[:2], -1)).sum(2)
    coder.radius = int(np.quantile(apart, coverage, method="higher"))
    widest = int(np.clip(round(np.log2(max(total, 2))) - VALUE_BITS, LEAST_WIDTH, MOST_WIDTH))
    least: list[tuple[float, int, int, int]] = []
    for width in range(LEAST_WIDTH, widest + 1):
        coder.width, coder.substrings = width, bits // width
        least.append(min(ways(asking, held, wanted, coder, coverage, total, share), default=(np.inf, width, 0, 0)))
        if min(least)[1] <= width - WORSE:
            break
    _, coder.width, coder.substrings, coder.probes = min(least)
    return coder


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0)
    return rows.where(good)


def _grid(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1), dtype=np.float64)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _nearest_of(asked, top: int):
    """(c, embedding) -> q, score, embedding: of each asked vector (place q) the nearest of the task's, at most `top`, itself left out."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors = asked.value
        rows, n = np.arange(len(own))[:, None], len(own)
        ids, scores, held = np.empty((n, 0), np.int64), np.empty((n, 0)), np.empty((n, 0, vectors.shape[1]))
        for batch in batches:
            c, x = batch.column("c").to_numpy(), _grid(batch.column("embedding"))
            found = np.where(own[:, None] == c, -np.inf, vectors @ x.T)
            at = np.argsort(-found, axis=1)[:, :top] if len(c) <= top else np.argpartition(-found, top - 1, axis=1)[:, :top]
            ids, scores, held = np.c_[ids, c[at]], np.c_[scores, found[rows, at]], np.concatenate([held, x[at]], axis=1)
            best = np.argsort(-scores, axis=1)[:, :top]
            ids, scores, held = ids[rows, best], scores[rows, best], held[rows, best]
        q, k = np.nonzero(ids != own[:, None])
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(scores[q, k]), _lists(held[q, k])], ["q", "score", "embedding"])

    return made


def nearest_of_all(classes: DataFrame, own: np.ndarray, vectors: np.ndarray, top: int) -> np.ndarray:
    """(vector, place, dims): the `top` nearest of all classes to a few of them, given by c and embedding, by comparing each class with these few."""
    asked = classes.sparkSession.sparkContext.broadcast((own, vectors))
    found = classes.select("c", "embedding").mapInArrow(_nearest_of(asked, top), "q long, score double, embedding array<double>")
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("_n") <= top)
    rows = best.select("q", "_n", "embedding").toPandas().sort_values(["q", "_n"])
    return np.stack(rows["embedding"].to_numpy()).reshape(len(own), -1, vectors.shape[1])


def _coded(coder, asking: bool):
    """(c, embedding) -> c, code (64-bit words), buckets: (substring, value) as one number."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = coder.value
        base = np.arange(how.substrings, dtype=np.int64) << how.width
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x = _grid(part.column("embedding"))
                sides = projected_queries(x, how) if asking else projected(x, how)
                buckets = (probe_values(sides, how) + base[:, None]).reshape(len(x), -1) if asking else values(sides, how) + base
                yield pa.RecordBatch.from_arrays([part.column("c"), _lists(words(sides).view(np.int64)), _lists(buckets.astype(np.int64))], ["c", "code", "buckets"])

    return made


def index_table(classes: DataFrame, coder, asking: bool, name: str, prefix: str) -> DataFrame:
    """A row for each (substring, value) of a class, or for each probe of a query: bucket, `name`, words of the code."""
    coded = classes.select("c", "embedding").mapInArrow(_coded(coder, asking), "c long, code array<long>, buckets array<long>")
    n_words = coder.value.planes.shape[1] // 64
    return coded.select(F.explode("buckets").alias("bucket"), F.col("c").alias(name), *(F.col("code")[k].alias(f"{prefix}{k}") for k in range(n_words)))


def met(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Every (query, class) that a probe finds in an index, with the codes' Hamming distance; once for each index that has it."""
    n_words = sum(c.startswith("code") for c in index.columns)
    apart: Column = sum((F.bit_count(F.col(f"code{k}").bitwiseXOR(F.col(f"asked{k}"))) for k in range(n_words)), F.lit(0))
    return probes.join(index, "bucket").select("q", "c", apart.alias("apart"))


def _rank(top: int):
    """Rows in order of block, vectors (tag 0) before queries (tag 1): a query's best among its candidates in the block, all of it where they are null."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, rows, x, order = None, [], [], None, None
        for batch in batches:
            blocks, tags = (batch.column(c).to_numpy() for c in ("block", "tag"))
            cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (tags[1:] != tags[:-1])) + 1).tolist(), len(blocks)]
            out: list[tuple] = []
            for low, high in zip(cuts, cuts[1:]):
                part = batch.slice(low, high - low)
                if not len(part):
                    continue
                if blocks[low] != block:
                    block, ids, rows, x = blocks[low], [], [], None
                if tags[low] == 0:
                    ids.append(part.column("id").to_numpy())
                    rows.append(_grid(part.column("embedding")))
                    continue
                if x is None:
                    x, held = np.concatenate(rows), np.concatenate(ids)
                    order = np.argsort(held)
                    held, rows = held[order], []
                asked = _grid(part.column("embedding"))
                for q, vector, found in zip(part.column("id").to_pylist(), asked, part.column("found")):
                    at = order if found.as_py() is None else order[np.searchsorted(held, found.values.to_numpy())]
                    scores = (x[at] * vector).sum(1)
                    best = np.arange(len(at)) if len(at) <= top else np.flatnonzero(scores >= np.partition(scores, -top)[-top])
                    out.append((np.full(len(best), q), held[np.searchsorted(held, found.values.to_numpy()[best])] if found.as_py() is not None else held[best], scores[best]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["q", "c", "score"])

    return made


def ranked(classes: DataFrame, asked: DataFrame, n_blocks: int, top: int) -> DataFrame:
    """classes (c, embedding), asked (block, q, embedding, found) -> q, c, score: the best `top` of each query and block, ties included."""
    vectors = classes.select(block_of("c", n_blocks).alias("block"), F.lit(0).alias("tag"), F.col("c").alias("id"), "embedding", F.lit(None).cast("array<long>").alias("found"))
    dealt = vectors.unionAll(asked.select("block", F.lit(1), "q", "embedding", "found")).repartition("block").sortWithinPartitions("block", "tag")
    return dealt.mapInArrow(_rank(top), "q long, c long, score double")


def block_of(column: str, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n_blocks)).cast("int")


def classes_of(rows: DataFrame, every: int, top: int) -> DataFrame:
    """vec_id, embedding -> c, h1, h2 (they name the vector), embedding, ids (the least top + 1), first_id, asked."""
    keyed = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    within = Window.partitionBy("h1", "h2", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id")
    least = keyed.select("h1", "h2", "vec_id").distinct().withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= top + 1)
    ids = least.groupBy("h1", "h2").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, top + 1).alias("ids"))
    one = keyed.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.max(F.pmod("vec_id", F.lit(every)) == 0).alias("asked"))
    return one.join(ids, ["h1", "h2"]).select(F.monotonically_increasing_id().alias("c"), "h1", "h2", "embedding", "ids", F.element_at("ids", 1).alias("first_id"), "asked")


def nearest(vectors: DataFrame, every: int = EVERY, top: int = TOP, bits: int = BITS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """embeddings -> query_id, rank, vec_id, score: the `top` nearest found of each row whose vec_id divides by `every`. bits: a multiple of 64."""
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    rows = valid(vectors)
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    rows = rows.where(F.size("embedding") == common["n"]).withColumn("embedding", F.transform("embedding", lambda c: c + F.lit(0.0)))
    classes = stored(classes_of(rows, every, top), "classes")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, c: s + c * c))
    n, n_asked, largest, n_ids = classes.agg(F.count("*"), F.count_if("asked"), F.max(norm), F.sum(F.size("ids"))).first()
    if not n_asked:
        return empty
    picked = classes.orderBy(F.xxhash64("h1"), "h2").limit(sample + SAMPLE_QUERIES).select("c", "embedding").toPandas()
    own, drawn = picked["c"].to_numpy(), np.stack(picked["embedding"].to_numpy())
    few = own[-SAMPLE_QUERIES:], drawn[-SAMPLE_QUERIES:]
    near = (few[1], nearest_of_all(classes, *few, top)) if n > 1 else None
    coder = spark.sparkContext.broadcast(learn(drawn[:sample], float(largest), n, bits, share=n_asked / n, near=near))
    n_blocks = -(-n // block)
    queries = classes.where("asked").select(F.col("c").alias("q"), "embedding")
    pairs = met(index_table(classes, coder, False, "c", "code"), index_table(classes.where("asked"), coder, True, "q", "asked"))
    found = pairs.where(F.col("apart") <= coder.value.radius).groupBy("q", block_of("c", n_blocks).alias("block")).agg(F.collect_set("c").alias("found"))
    by_class = Window.partitionBy("q").orderBy(F.desc("score"), "first_id")
    firsts = classes.select("c", "first_id", "ids")

    def best_of(asked: DataFrame, name: str) -> DataFrame:
        best = ranked(classes, asked, n_blocks, top + 1).join(firsts, "c")
        return stored(best.withColumn("_n", F.row_number().over(by_class)).where(F.col("_n") <= top + 1).select("q", "score", "ids"), name)

    best = best_of(found.join(queries, "q").select("block", "q", "embedding", "found"), "best")
    enough = best.groupBy("q").agg(F.sum(F.size("ids")).alias("_n")).where(F.col("_n") >= min(top + 1, n_ids))
    short = stored(queries.join(enough, "q", "left_anti"), "short")
    if short.limit(1).count():
        whole = short.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "q", "embedding", F.lit(None).cast("array<long>").alias("found"))
        best = best.join(short.select("q"), "q", "left_anti").unionAll(best_of(whole, "best-short"))
    named = best.select("q", "score", F.explode("ids").alias("vec_id"))
    by_row = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    answers = named.withColumn("_n", F.row_number().over(by_row)).where(F.col("_n") <= top + 1).drop("_n")
    own = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")).distinct()
    own = own.join(classes.where("asked").select("h1", "h2", F.col("c").alias("q")), ["h1", "h2"]).join(answers, "q").where("vec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
