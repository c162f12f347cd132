"""The corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as
Parquet and read again before the next. All but the last return the columns of documents, extra ones
included, whatever their names. Null and empty texts are rows like others: the quality stage scores them, and they
are near to nothing and hit by nothing. Texts are read whole. Repeated rows: the near-duplicate stage keeps or drops all rows of a doc_id together and keeps
rows without one; mixing takes all copies of an id and text if it takes one, so its budget can be passed by copies. An empty table gives an empty result. SQL can express neither the classifier nor the curve. Tests compare the quality stage with scores of plain Python and with the labels, near duplicates and
decontamination with all pairs and all windows, mixing with SQL over its input, and sharding with its law.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiatscan.llm import decontaminate, mixing, near_dedup, quality, sharding
from fiatscan.llm.common import free_name, stored, table

BUDGET_PERCENT = 90
#: Near copies from a similarity of 0.80 on. 35 bands of 5 miss such a pair with a chance below one in a million.
NEAR_PERCENT = 80
NEAR_BANDS = 35
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression classifier accepts; all rows where there are too few labels to fit one."""
    name = free_name(docs, "score")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if not model.fitted:
        return docs
    return quality.score(docs, model, name).where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the smallest doc_id of each near-duplicate group; rows without doc_id stay."""
    found = near_dedup.near_duplicates(docs, threshold=NEAR_PERCENT, bands=NEAR_BANDS)
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any benchmark window."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    id_name, digest_name = free_name(docs, "id"), free_name(docs, "digest")
    hit = found.select(F.col("_id").alias(id_name), F.col("_digest").alias(digest_name)).distinct()
    keyed = docs.withColumns({id_name: decontaminate.row_id(), digest_name: decontaminate.text_digest()})
    return keyed.join(hit, [id_name, digest_name], "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the hierarchical budget takes, whole or in part, each once."""
    taken = mixing.mix(docs, budget_percent=BUDGET_PERCENT, max_epochs=1).where("taken > 0")
    id_name, hash_name = free_name(docs, "id"), free_name(docs, "hash")
    chosen = taken.select(F.coalesce("doc_id", F.lit(-1)).alias(id_name), F.col("text_hash").alias(hash_name)).distinct()
    keyed = docs.withColumns({id_name: F.coalesce("doc_id", F.lit(-1)), hash_name: F.xxhash64("text")})
    return keyed.join(chosen, [id_name, hash_name], "left_semi").select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
