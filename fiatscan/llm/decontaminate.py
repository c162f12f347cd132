"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item gives windows of `size` consecutive words (one shorter window, if it has fewer). A
window occurs in a document only if every one of its shingles does, so one shingle of it is a
sufficient prefix: the rarest, by counts over all documents. Documents are joined with the windows on
those rarest shingles alone. A match at position p of a window whose shingle is at offset o is kept
only if the window fits the document, 0 <= p - o and p - o + length <= words, and is then verified word
by word. Words are counted as hit if any verified occurrence covers them.

The rarest shingles are broadcast only while there are at most `broadcast_limit` of them; beyond that
every shingle of a document goes into the join, which then needs no filter. Counts are pre-aggregated
per batch. Hot shingles are split by the skew handling of Spark's joins.

Null, empty and wordless texts have no words and hit nothing; null and wordless items have no windows.
Equal windows of several items count for each item. Rows that repeat a doc_id are judged each on its
own text. Without documents the result is empty; without items nothing is hit. Texts of any length are
read whole, in batches of bounded rows. Other columns, of whatever name, are left unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stored
from .hashing import ALNUM, chained, chunks, words_of

SIZE = 10
SHINGLE = 3
BROADCAST_LIMIT = 2_000_000
POSTINGS = "array<struct<pos:long,shingle:long,first:long,around:array<binary>>>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def item_windows(items: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """item_id, text -> item_id, words (array of binary), length, shingles (array of hashes by offset), width (words of a shingle)."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [bytes(t) if t is not None else b"" for t in pdf["text"]]
            rows = []
            for item, text in zip(pdf["item_id"], texts):
                words = words_of([text], ALNUM)
                n = len(words.hashes)
                length = min(size, n)
                width = min(shingle, length)
                hashes = _signed(chained(words.hashes, width)) if n else None
                seen = set()
                for i in range(n - length + 1 if n else 0):
                    run = [words.text(j) for j in range(i, i + length)]
                    key = b" ".join(run)
                    if key not in seen:
                        seen.add(key)
                        rows.append((item, run, length, hashes[i : i + length - width + 1].tolist(), width))
            out = pd.DataFrame(rows, columns=["item_id", "words", "length", "shingles", "width"])
            out["item_id"] = out["item_id"].astype("Int64")
            yield out

    return items.select("item_id", F.col("text").cast("binary").alias("text")).mapInPandas(made, "item_id long, words array<binary>, length long, shingles array<long>, width int")


def _positions(hashes: np.ndarray, widths: list[int], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the wanted shingles (all, if None) of one document or chunk."""
    at, found = [], []
    for width in widths:
        all_ = chained(hashes, width)
        if wanted is None:
            hit = np.arange(len(all_))
        else:
            place = np.searchsorted(wanted, all_)
            hit = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == all_) if len(wanted) else np.zeros(0, np.int64)
        at.append(hit)
        found.append(all_[hit])
    return np.concatenate(at), np.concatenate(found)


def count_batch(texts: list[bytes], widths: list[int], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and in how many of the texts each occurs."""
    docs, found = [], []
    for part in chunks([len(t) for t in texts]):
        words = words_of(texts[part], ALNUM)
        for width in widths:
            at, hashes = _positions(words.hashes, [width], wanted)
            doc = np.searchsorted(words.bounds, at, "right") - 1
            whole = at + width <= words.bounds[doc + 1]
            docs.append(doc[whole] + part.start)
            found.append(hashes[whole])
    if not docs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc, hashes = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((doc, hashes))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return np.unique(hashes[new], return_counts=True)


def postings_batch(texts: list[bytes], widths: list[int], wanted: np.ndarray | None, size: int) -> list[tuple[int, list]]:
    """Word count and postings of each text: position, shingle, and the words that a window over it may hold."""
    out = []
    for part in chunks([len(t) for t in texts]):
        words = words_of(texts[part], ALNUM)
        at, hashes = _positions(words.hashes, widths, wanted)
        order = np.argsort(at, kind="stable")
        at, hashes = at[order], _signed(hashes[order])
        cut = np.searchsorted(at, words.bounds)
        for i in range(len(words.bounds) - 1):
            low, high = words.bounds[i], words.bounds[i + 1]
            found = []
            for p, h in zip(at[cut[i] : cut[i + 1]].tolist(), hashes[cut[i] : cut[i + 1]].tolist()):
                first = max(low, p - size + 1)
                found.append({"pos": p - low, "shingle": h, "first": first - low, "around": [words.text(j) for j in range(first, min(high, p + size))]})
            out.append((int(high - low), found))
    return out


def _count(widths: list[int], wanted):
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = None if wanted is None else wanted.value
        for pdf in batches:
            hashes, n = count_batch([bytes(t) for t in pdf["text"]], widths, known)
            yield pd.DataFrame({"shingle": hashes.view(np.int64), "n": n.astype(np.int64)})

    return made


def _post(widths: list[int], wanted, size: int):
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = None if wanted is None else wanted.value
        for pdf in batches:
            got = postings_batch([bytes(t) for t in pdf["text"]], widths, known, size)
            yield pd.DataFrame({"_id": pdf["_id"], "_digest": pdf["_digest"], "doc_id": pdf["doc_id"], "n_words": [n for n, _ in got], "postings": [p for _, p in got]})

    return made


def _bounded_set(shingles: DataFrame, limit: int):
    """The distinct shingles as a broadcast sorted array, or None if there are more than the limit."""
    spark = shingles.sparkSession
    found = shingles.distinct().limit(limit + 1).toPandas()
    if len(found) > limit:
        return None
    return spark.sparkContext.broadcast(np.sort(found.iloc[:, 0].to_numpy(np.int64).view(np.uint64)))


def row_id() -> Column:
    return F.coalesce("doc_id", F.lit(-1))


def text_digest() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, shingle: int = SHINGLE, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """documents, benchmark -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, and _id, _digest that name the row's text."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark, 1000)
    windows = stored(item_windows(items, size, shingle).withColumn("window", F.md5(F.concat_ws(" ", F.transform("words", F.hex)))), "item-windows")
    distinct = windows.dropDuplicates(["window"]).select("window", "words", "length", "shingles", "width")
    widths = sorted(r[0] for r in windows.select("width").distinct().collect()) or [shingle]
    base = docs.select("doc_id", row_id().alias("_id"), text_digest().alias("_digest"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    offsets = distinct.select("window", F.posexplode("shingles").alias("offset", "shingle"))
    vocabulary = _bounded_set(offsets.select("shingle"), broadcast_limit)
    counts = base.select("text").mapInPandas(_count(widths, vocabulary), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rated = offsets.join(counts, "shingle", "left")
    rarest = rated.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("r"))
    prefixes = stored(distinct.join(rarest, "window").where("r.n > 0").select("window", "words", "length", F.col("r.shingle").alias("shingle"), F.col("r.offset").alias("offset")), "prefixes")
    wanted = _bounded_set(prefixes.select("shingle"), broadcast_limit)
    posted = stored(base.mapInPandas(_post(widths, wanted, size), f"_id long, _digest string, doc_id long, n_words long, postings {POSTINGS}"), "postings")
    met = posted.where(F.size("postings") > 0).select("_id", "_digest", "n_words", F.explode("postings").alias("p")).select("_id", "_digest", "n_words", "p.*")
    begin = F.col("pos") - F.col("offset")
    fits = (begin >= 0) & (begin + F.col("length") <= F.col("n_words"))
    same = F.slice("around", (begin - F.col("first") + 1).cast("int"), F.col("length").cast("int")) == F.col("words")
    hits = met.join(prefixes, "shingle").where(fits).where(same).select("_id", "_digest", begin.alias("begin"), (begin + F.col("length")).alias("end"), "window")
    hits = stored(hits.distinct(), "hits")
    order = Window.partitionBy("_id", "_digest").orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select("_id", "_digest", "begin", "end").distinct()
    covered = spans.withColumn("_reach", F.coalesce(reach, F.lit(0))).withColumn("_new", F.greatest(F.lit(0), F.col("end") - F.greatest("begin", "_reach")))
    covered = covered.groupBy("_id", "_digest").agg(F.sum("_new").alias("n_hit"))
    met_items = hits.select("_id", "_digest", "window").distinct().join(windows.select("window", "item_id"), "window").select("_id", "_digest", F.col("item_id").cast("string").alias("item")).distinct()
    met_items = met_items.groupBy("_id", "_digest").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    found = covered.join(met_items, ["_id", "_digest"], "left")
    out = posted.select("_id", "_digest", "doc_id", "n_words").join(found, ["_id", "_digest"], "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), ids.alias("item_ids"), "_id", "_digest")
