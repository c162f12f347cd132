"""Line deduplication by levelled sorted runs.

All lines are hashed in one pass over the documents and dealt to batches of ascending doc_id. The store holds runs of (line hash, owner),
bucketed and sorted by hash, each hash in one run only. A batch anti-joins its hashes with the runs; what is new is owned by
the batch's smallest doc_id and becomes a run of level 0. When a level holds `fanin` runs, they are
merged into one run of the next level, so a hash is rewritten as often as there are levels and a batch
looks into few runs. As batches ascend, the first owner is the smallest doc_id of all. Runs have as many buckets as a shuffle has
partitions, so that anti-joins and merges read them in place: no run is shuffled or sorted again until the owners of all lines are looked up, where
a hot line must be split over tasks.

A key is a line stripped at both ends and lower-cased (A-Z). Keys under `min_chars` code points are never
dropped. A line is dropped if its key's owner is another document; all occurrences in the owner stay.
A null or empty text is one empty line; an empty table gives no rows. Rows that repeat a doc_id are one document: all of them are
treated alike. A null doc_id counts as greater than every other. Other columns, whatever their names, are ignored. A very long text is split whole
and rebuilt whole, one at a time. Hot lines are pre-aggregated before
each shuffle and joined with skew handling; no group of lines meets in one task.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, new_table, setting, small_batches

BATCHES = 6
BATCH_ROWS = 50_000_000
FANIN = 2
MIN_CHARS = 10
SCAN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"
LAST = (1 << 63) - 1
SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACE)), _UPPER, _LOWER)


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """id, text hash, batch, pos, hash of every line whose key is long enough."""
    lines = docs.select("_id", "_text_hash", "_batch", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("_id", "_text_hash", "_batch", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("_id", "_text_hash", "_batch", "pos", F.unhex(F.md5(F.col("key").cast("binary"))).alias("hash"))


class RunStore:
    """Runs of (hash, owner) in levels, each a table in the shared folder, bucketed and sorted by hash."""

    def __init__(self, spark: SparkSession, fanin: int = FANIN):
        self.spark, self.fanin = spark, fanin
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []  # name and path

    def runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def owners(self) -> DataFrame:
        """All (hash, owner), as plain files, so that a join can be split where a hash is hot."""
        return self.spark.read.schema("hash binary, owner long").parquet(*[path for _, path in self.runs()])

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = new_table(self.spark, "run")
        with setting(self.spark, SCAN_ORDER, "true"):
            rows.select("hash", "owner").write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)
        return name, path

    def add(self, batch: DataFrame) -> None:
        """Adds what the runs lack of batch (hash, owner; one row a hash), then merges full levels."""
        fresh = reduce(lambda rows, run: rows.join(self.spark.table(run[0]).select("hash"), "hash", "left_anti"), self.runs(), batch)
        self._put(0, self._write(fresh))

    def _put(self, level: int, run: tuple[str, str]) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanin:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._write(reduce(_merge, [self.spark.table(name) for name, _ in full])))


def _merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two runs without a common hash as one: a merge of what lies sorted in equal buckets."""
    other = right.select(F.col("hash").alias("_hash"), F.col("owner").alias("_owner"))
    return left.join(other, left["hash"] == other["_hash"], "full_outer").select(F.coalesce("hash", "_hash").alias("hash"), F.coalesce("owner", "_owner").alias("owner"))


def _rebuild(keep_text: bool):
    def kept(batches):
        for pdf in batches:
            out = []
            for text, gone in zip(pdf["_text"], pdf["gone"]):
                lines = text.split("\n")
                if gone is not None and len(gone):
                    drop = set(map(int, gone))
                    left = [x for i, x in enumerate(lines) if i not in drop]
                    out.append((len(lines), len(drop), "\n".join(left)))
                else:
                    out.append((len(lines), 0, text))
            made = pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])
            made["kept_sha256"] = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in made["kept"]]
            made.insert(0, "doc_id", pdf["_id"].where(pdf["_id"] != LAST).astype("Int64").values)
            yield made if keep_text else made.drop(columns="kept")

    return kept


def dedup_lines(docs: DataFrame, batches: int | None = None, fanin: int = FANIN, min_chars: int = MIN_CHARS, keep_text: bool = True) -> DataFrame:
    """documents -> doc_id, n_lines, n_dropped, (kept,) kept_sha256, a row for each input row.

    batches: by default BATCHES, more where a batch would have over BATCH_ROWS documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    base = base.withColumn("_text_hash", F.xxhash64("_text"))
    batches = batches or max(BATCHES, -(-base.count() // BATCH_ROWS))
    cuts = base.select(F.percentile_approx("_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    batch = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < F.col("_id"))) if cuts else F.lit(0)
    path = new_path(spark, "lines")
    made = long_lines(base.withColumn("_batch", batch), min_chars)
    made.write.partitionBy("_batch").parquet(path)
    lines = spark.read.schema(made.schema).parquet(path)
    store = RunStore(spark, fanin)
    for k in range(len(cuts) + 1):
        store.add(lines.where(F.col("_batch") == k).groupBy("hash").agg(F.min("_id").alias("owner")))
    gone = lines.join(store.owners(), "hash").where(F.col("owner") != F.col("_id"))
    gone = gone.groupBy("_id", "_text_hash").agg(F.collect_set("pos").alias("gone"))
    joined = base.join(gone, ["_id", "_text_hash"], "left").select("_id", "_text", "gone")
    schema = "doc_id long, n_lines long, n_dropped long, " + ("kept string, " if keep_text else "") + "kept_sha256 string"
    return joined.mapInPandas(_rebuild(keep_text), schema)
