"""The pipeline on the small tables: each stage judged on its own input."""

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from fiatscan.llm import mixing
from fiatscan.llm.common import stored, table

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_stages_keep_what_they_should(spark):
    from pyspark.sql import functions as F

    docs = table(spark, SF, "documents").withColumns({"_score": F.lit(1), "_id": F.lit("x"), "kept": F.lit(True)})
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == before.columns
    quality = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    before, after = ({r.doc_id for r in d.collect()} for d in seen["quality"])
    wrong = [i for i in before if i in quality and (i in after) != bool(quality[i])]
    assert len(wrong) <= 0.1 * len(quality)

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0d]+", text.translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    left = [(r.doc_id, shingles(r.text)) for r in seen["near_duplicates"][1].collect()]
    assert not [(a, b) for k, (a, s) in enumerate(left) for b, t in left[:k] if s and t and 100 * len(s & t) >= 85 * len(s | t)]

    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = WORD.findall(r.text.encode().lower())
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}

    def leaks(text):
        w = WORD.findall(text.encode().lower())
        return any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))

    before, after = ({r.doc_id: r.text for r in d.collect()} for d in seen["decontamination"])
    assert set(after) == {i for i, t in before.items() if not leaks(t)}
    before, after = seen["mixing"]
    con = duckdb.connect()
    frame = before.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841
    con.execute("create view documents as select * from frame")
    want = con.execute(f"select doc_id from ({mixing.oracle_sql(corpus_pipeline.BUDGET_PERCENT, 1)}) x where taken > 0").fetchall()
    assert sorted(r[0] for r in want) == sorted(r.doc_id for r in after.collect()) and len(want) < len(frame)
    shards, before = docs.collect(), {r.doc_id: r for r in seen["sharding"][0].collect()}
    assert sorted(r.doc_id for r in shards) == sorted(before)
    assert all(r["size"] == len(before[r.doc_id].text.encode()) + 1 and r.text_crc32 == zlib.crc32(before[r.doc_id].text.encode()) for r in shards)
    count = Counter(r.shard for r in shards)
    assert set(count) == set(range(8)) and max(count.values()) - min(count.values()) <= 1
    assert sorted((r.shard, r.slot) for r in shards) == [(k, n) for k in range(8) for n in range(count[k])]
    shards.sort(key=lambda r: (r.shard, r.slot))
    assert all(a.curve <= b.curve for a, b in zip(shards, shards[1:]))


def test_quality_stage_keeps_all_without_a_model(spark, tmp_path):
    docs = table(spark, SF, "documents").limit(50)
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.keep_quality(spark, docs, str(tmp_path)).count() == 50


def test_stages_on_awkward_rows(spark):
    from pyspark.sql import functions as F

    some = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, SF, "documents").limit(40).collect()]
    odd = [(900001, None, None, None, None), (900002, "", "en", "src1", 0), (None, some[0][1], None, "src0", 1), (None, None, None, None, None), (some[3][0], some[3][1], "en", "src0", 2), (900003, some[4][1] * 60, "en", "src0", 3)]
    docs = spark.createDataFrame(some + odd, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("_id", "_digest", "_hash", "_score", "shard", "key", "node", "component", "taken")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "sharding":
            assert out.count() == len(some) + len(odd)
        else:
            assert out.columns == docs.columns and 0 < out.count() <= len(some) + len(odd)
        if name == "near_duplicates":
            kept = [r.doc_id for r in out.collect()]
            assert kept.count(None) == 2 and kept.count(some[3][0]) == 2
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_duplicate_stage_equals_all_pairs_at_080(spark):
    rng = random.Random(11)
    texts = []
    for k in range(40):
        base = [f"w{rng.randint(0, 9999)}" for _ in range(100)]
        texts.append(base)
        for spots in ((50,), (30, 60), (30, 50, 70))[: 1 + k % 3]:
            texts.append([f"x{rng.randint(0, 9999)}" if at in spots else w for at, w in enumerate(base)])
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    rows = list(enumerate(map(" ".join, texts)))
    rng.shuffle(rows)
    held = list(range(len(sets)))
    between = 0
    for a, s in enumerate(sets):
        for b, t in enumerate(sets[:a]):
            same = len(s & t) / len(s | t)
            between += 0.80 <= same < 0.85
            if same >= 0.80:
                low, high = sorted((held[a], held[b]))
                held = [low if h == high else h for h in held]
    assert between > 20
    got = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(held))
