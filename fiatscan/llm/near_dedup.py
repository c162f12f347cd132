"""Near-duplicate documents by circulant MinHash.

A document's set holds the distinct runs of `width` words, A-Z lowered; with fewer words, the whole
sequence as one. Two permutations give all signature coordinates: the first scatters the set over a
circle of 2**32 places, the second, shifted round the circle by k places, ranks them for coordinate k,
which keeps the least rank. Bands of coordinates send documents to buckets.

Documents with equal sets are one class, named by the set's digest, so copies cost one row; a document of several rows is in as many classes. Sets that share a bucket are
compared in full, and linked with 100 * intersection >= threshold * union, in two steps:

1. A star: every member of a bucket is compared with the smallest of all members of its buckets. In a group of near copies this links
   nearly all, at one comparison a member. A smallest member with many others is dealt to several tasks, with `star_block` others each.
2. What is left: buckets whose members are not yet all in one component of the star's links. Their members, in families joined by such buckets, are cut into
   blocks, and a task gets two blocks and compares members of different components only. A component that fills blocks of its own is not
   compared with itself at all. A task returns no more links than join its members
   into components, so neither copies nor links are expanded into pairs. A task's share of a family is bounded: `block`
   rows, or a fortieth of the family where it is larger, up to `block_limit`.

A pair of similarity 0.85 shares none of 25 bands of 5 with a chance below one in a million.

Null, empty and wordless texts have an empty set and are linked with nothing; an empty table gives no rows. Rows that repeat a doc_id
are one document with the links of all of them. Rows without doc_id are kept, with no component. Other columns, whatever their names, are ignored. Very long
texts are read whole, in batches of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .components import components
from .hashing import _ODD, SPACED, chained, chunks, mix, words_of

WIDTH = 5
THRESHOLD = 85
BANDS = 25
ROWS = 5
BLOCK = 64
BLOCK_LIMIT = 1024
STAR_BLOCK = 256
_SCATTER = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for part in chunks([len(t) for t in texts]):
        words = words_of(texts[part], SPACED)
        runs = chained(words.hashes, width)
        for low, high in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
            n = high - low
            out.append(np.unique(runs[low : high - width + 1] if n >= width else chained(words.hashes[low:high], n) if n else words.hashes[:0]))
    return out


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """The least rank of the set under each shift of the second permutation."""
    circle = (mix(shingles ^ _SCATTER) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(circle), 1024):
        x = circle[None, start : start + 1024] - shifts
        t = x >> np.uint32(16)
        x ^= t
        x *= np.uint32(0x21F0AAAD)
        np.right_shift(x, np.uint32(15), out=t)
        x ^= t
        x *= np.uint32(0xD35A2D97)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of each signature."""
    grid = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    keys = (grid * _ODD[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(keys)


def set_digest(shingles: np.ndarray) -> int:
    """One number for the whole set, whatever the order."""
    return int(mix(np.array([mix(shingles + np.uint64(1)).sum(dtype=np.uint64) ^ np.uint64(len(shingles))], np.uint64))[0].view(np.int64)) if len(shingles) else 0


def _sketch(width: int, bands: int, rows: int):
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = shingle_sets([bytes(t) for t in pdf["text"]], width)
            digests = [set_digest(s) for s in sets]
            known: dict[int, list] = {}
            for digest, found in zip(digests, sets):
                if len(found) and digest not in known:
                    known[digest] = band_keys(signature(found, bands * rows)[None], bands, rows).view(np.int64)[0]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "hash": pdf["hash"], "digest": digests, "n_shingles": [len(s) for s in sets], "bands": [known.get(d) if len(s) else None for d, s in zip(digests, sets)]})

    return made


def _sets(width: int):
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # rows that repeat a class's row are read once a task
        for pdf in batches:
            pdf = pdf[~pdf["node"].isin(seen)].drop_duplicates(["node", "text"])
            sets = shingle_sets([bytes(t) for t in pdf["text"]], width)
            right = np.array([set_digest(s) for s in sets], np.int64) == pdf["node"].to_numpy(np.int64)
            seen.update(pdf["node"][right])
            yield pdf[["node"]].assign(shingles=[s.tobytes() for s in sets])[right].drop_duplicates("node")

    return made


def links_of(nodes: np.ndarray, sides: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Links between members of different groups that join the members into the components of all such links.

    Members with side 0 or 1 are compared with the other side only, with side 2 with every one of it.
    """
    n = len(nodes)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    values, column, count = np.unique(everything, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)
    for start in range(0, len(shared), 4096):
        low, high = np.searchsorted(column, [start, start + 4096])
        grid = np.zeros((n, min(4096, len(shared) - start)), np.float32)
        grid[owner[low:high], column[low:high] - start] = 1
        common += grid @ grid.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = 100 * common.astype(np.float64) >= threshold * union.astype(np.float64)
    linked &= ((sides[:, None] == 2) | (sides[:, None] != sides[None, :])) & (groups[:, None] != groups[None, :])
    left, right = np.nonzero(np.triu(linked, 1))
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(left.tolist(), right.tolist()):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _verify(threshold: int):
    keys = ["family", "i", "j"]

    def group(rows: pd.DataFrame) -> list[tuple[int, int]]:
        sides = np.full(len(rows), 2) if rows["i"].iat[0] == rows["j"].iat[0] else (rows["block"] == rows["j"]).to_numpy(np.int64)
        return links_of(rows["node"].to_numpy(), sides, rows["component"].to_numpy(), [np.frombuffer(s, np.uint64) for s in rows["shingles"]], threshold)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
            rest = pdf[last]
            found = [link for _, rows in pdf[~last].groupby(keys, sort=False) if len(rows) > 1 for link in group(rows)]
            yield pd.DataFrame(found, columns=["a", "b"])
        if rest is not None and len(rest) > 1:
            yield pd.DataFrame(group(rest), columns=["a", "b"])

    return made


def linked(left: np.ndarray, right: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets are similar enough."""
    common = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * common >= threshold * (len(left) + len(right) - common)


def _stars(threshold: int):
    """Rows in order of head, salt and tag, the head itself (tag 0) before its members (tag 1): the links of members to heads."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, own = None, None
        for pdf in batches:
            out = []
            for at, tag, node, shingles in zip(pdf["head"], pdf["tag"], pdf["node"], pdf["shingles"]):
                if tag == 0:
                    head, own = at, np.frombuffer(shingles, np.uint64)
                elif at == head and linked(own, np.frombuffer(shingles, np.uint64), threshold):
                    out.append((at, node))
            yield pd.DataFrame(out, columns=["a", "b"])

    return made


def star_links(sets: DataFrame, heads: DataFrame, threshold: int, star_block: int) -> DataFrame:
    """sets (node, shingles), heads (node, head: another node) -> a, b: the pairs of heads that are linked."""
    salts = heads.groupBy("head").agg(F.ceil(F.count("*") / star_block).cast("int").alias("salts"))
    dealt = heads.join(salts, "head").select("node", "head", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("tag"))
    own = salts.select(F.col("head").alias("node"), "head", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("tag"))
    rows = sets.join(dealt.unionByName(own), "node").repartition("head", "salt").sortWithinPartitions("head", "salt", "tag", "node")
    return rows.select("head", "tag", "node", "shingles").mapInPandas(_stars(threshold), "a long, b long")


def block_links(sets: DataFrame, members: DataFrame, threshold: int, block: int, block_limit: int) -> DataFrame:
    """sets, members (node, family, component) -> a, b: links between components inside families."""
    sizes = members.groupBy("family").agg(F.count("*").alias("size"))
    limit = F.when(F.col("size") <= 2 * block, 2 * block).otherwise(F.least(F.greatest(F.lit(block), F.ceil(F.col("size") / 40)), F.lit(block_limit))).cast("int")
    parts = members.groupBy("family", "component").agg(F.count("*").alias("n")).join(sizes.select("family", limit.alias("limit")), "family")
    large = F.col("n") > F.col("limit")
    parts = stored(parts.select("family", "component", F.when(large, F.col("component")).alias("alone"), "n", "limit"), "parts")
    filled = parts.groupBy("family", "alone").agg(F.ceil(F.sum("n") / F.max("limit")).cast("int").alias("n_blocks"))
    # a block is of one large component, or of all small ones
    block_id = lambda alone, k: F.struct(F.coalesce(alone, F.lit(-(1 << 63))).alias("alone"), k.alias("k"))
    blocks = stored(filled.select("family", "alone", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("k")).select("family", "alone", block_id(F.col("alone"), F.col("k")).alias("block")), "blocks")
    other = blocks.select("family", F.col("alone").alias("_alone"), F.col("block").alias("j"))
    pairs = blocks.withColumnRenamed("block", "i").join(other, "family").where("i <= j and not coalesce(alone = _alone, false)").select("family", "i", "j")
    placed = members.join(parts.drop("n", "limit"), ["family", "component"]).join(filled.select("family", F.col("alone").alias("_alone"), "n_blocks"), "family").where(F.col("alone").eqNullSafe(F.col("_alone")))
    placed = placed.select("node", "family", "component", block_id(F.col("alone"), F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")).alias("block"))
    ends = pairs.select("family", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    named = placed.join(ends, ["family", "block"]).select("node", "family", "component", *[F.xxhash64(c).alias(c) for c in ("i", "j", "block")])
    dealt = sets.join(named, "node").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node")
    return dealt.mapInPandas(_verify(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, block_limit: int = BLOCK_LIMIT, star_block: int = STAR_BLOCK) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id, kept, a row for each input row."""
    spark = docs.sparkSession
    small_batches(spark, 1000)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    sketched = stored(base.mapInPandas(_sketch(width, bands, rows), "doc_id long, hash long, digest long, n_shingles long, bands array<long>"), "sketches")
    named = sketched.where("doc_id is not null and n_shingles > 0")
    one = F.min(F.struct("doc_id", "hash", "bands")).alias("r")
    classes = stored(named.groupBy(F.col("digest").alias("node")).agg(one).select("node", F.col("r.doc_id").alias("owner"), F.col("r.hash").alias("hash"), F.col("r.bands").alias("bands")), "classes")
    spread = classes.select("node", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head <> tail").select("key", "head")
    buckets = stored(spread.join(shared, "key").select("key", "node", "head"), "buckets")
    heads = stored(buckets.groupBy("node").agg(F.min("head").alias("head")), "heads")
    members = classes.select("node", F.col("owner").alias("doc_id"), "hash").join(heads.select("node"), "node")
    sets = stored(base.join(members, ["doc_id", "hash"]).select("node", "text").mapInPandas(_sets(width), "node long, shingles binary"), "sets")
    near = stored(star_links(sets, heads.where("node <> head"), threshold, star_block), "star-links")
    joined = components(near)
    placed = buckets.join(joined.select("node", "component"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    apart = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("node").alias("head")).where("least <> most").select("key", "head")
    left = stored(placed.join(apart, "key").groupBy("node", "component").agg(F.collect_set("head").alias("heads")), "left")
    star = left.select(F.array_min("heads").alias("a"), F.explode(F.array_union("heads", F.array("node"))).alias("b")).where("a <> b").distinct()
    families = components(star).select("node", F.col("component").alias("family"))
    rest = block_links(sets, stored(left.join(families, "node").select("node", "family", "component"), "families"), threshold, block, block_limit)
    owner = lambda side: classes.select(F.col("node").alias(side), F.col("owner").alias(f"{side}_owner"))
    between = near.union(stored(rest, "links")).join(owner("a"), "a").join(owner("b"), "b").select(F.col("a_owner").alias("a"), F.col("b_owner").alias("b"))
    repeated = named.select("digest", "doc_id").join(classes.select(F.col("node").alias("digest"), "owner"), "digest").where("doc_id <> owner").select(F.col("owner").alias("a"), F.col("doc_id").alias("b"))
    held = components(between.union(stored(repeated, "copies")))  # of documents, so that those of several texts hold their classes together
    out = sketched.select("doc_id", "n_shingles").join(held.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
