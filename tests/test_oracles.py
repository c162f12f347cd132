"""Every registered query against its SQL, on the smallest tables; streams against their batch forms' SQL."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from fiatscan.jobs import registry  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    return str(value) if isinstance(value, str) else repr(round(float(value), 7))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    found = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    order = [columns.index(c) for c in got.columns]
    want = sorted(tuple(plain(r[k]) for k in order) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in got.collect()) == want and want


def test_variants_cover_every_image(spark):
    got = registry.queries()["variant_results"](spark, SF).collect()
    images = registry.queries()["rejected_texts"](spark, SF).count()
    assert len(got) == images and all(r.rejected == (r.score is None) == (r.amount is None) for r in got)
    assert any(r.region_count == 0 for r in got) and any(not r.rejected for r in got)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
