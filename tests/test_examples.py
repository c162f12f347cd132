"""Known inputs and outputs of every function, and small models of the ordered folds."""

import json
import random
import re
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiatscan.functions import geometry, money, text_price
from fiatscan.operators import fragments, frames, grid, held, rates, readings, scan, spatial, wallets
from fiatscan.schemas import ASSETS, FIATS
from fiatscan.sources import feeds

PRICES = [
    ("€12.99", None, 12.99, "EUR"), ("12,99 EUR", None, 12.99, "EUR"), ("$24.50", None, 24.5, "USD"), ("24.50 USD", None, 24.5, "USD"), ("£9.99", None, 9.99, "GBP"), ("CHF 12.99", None, 12.99, "CHF"),
    ("Fr. 9.50", None, 9.5, "CHF"), ("€1.234,56", None, 1234.56, "EUR"), ("Total\n€12.99\nThank you", None, 12.99, "EUR"), ("TOTAL € 12, 99", None, 12.99, "EUR"), ("TOTAL EUR 12,99", None, 12.99, "EUR"),
    ("SPECIAL OFFER 12.99", "EUR", 12.99, "EUR"), ("Open 9am - 5pm", None, None, None), ("€10,-", None, 10.0, "EUR"), ("10,- EUR", None, 10.0, "EUR"), ("Fr. 5.-", None, 5.0, "CHF"), ("12,-", "EUR", 12.0, "EUR"),
    ("¥1500", None, 1500.0, "JPY"), ("₹999", None, 999.0, "INR"), ("€095", None, 0.95, "EUR"), ("1,99 GBP", "EUR", 1.99, "EUR"), ("¥8", "EUR", None, None), ("$2.89", "EUR", None, None), ("€ 3. 99", None, 3.99, "EUR"),
    ("3 . 99", "EUR", 3.99, "EUR"), ("€ 3.\n99", None, 3.99, "EUR"), ("3.\n99", "EUR", 3.99, "EUR"), ("€ 3 99", None, 3.99, "EUR"), ("3 99", "EUR", 3.99, "EUR"), ("2 7 99", "EUR", None, None),
    ("15 GBP", "EUR", 15.0, "GBP"), ("12 euro", None, 12.0, "EUR"), ("€1.234", None, 1234.0, "EUR"), ("€12.5", None, 125.0, "EUR"), ("$1,234.50", None, 1234.5, "USD"), ("eur 3 99", None, 3.99, "EUR"), ("095 usd", None, 0.95, "USD"),
    ("3 99 chf", None, 3.99, "CHF"), ("€ 3 99", None, 3.99, "EUR"), ("é99 USD", None, 99.0, "USD"), (None, "EUR", None, None), ("", None, None, None), ("no digits € here", "EUR", None, None),
]


def test_prices_in_text(spark):
    rows = spark.createDataFrame([(i, t, c) for i, (t, c, *_) in enumerate(PRICES)], "i int, text string, scan string")
    got = {r.i: (r.amount, r.currency) for r in text_price.detect(rows, "text", F.col("scan")).collect()}
    assert got == {i: (a, c) for i, (*_, a, c) in enumerate(PRICES)}


def one(spark, columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_formats(spark):
    asset = lambda a, x: money.asset_text(F.lit(a), F.lit(float(x)))
    got = one(spark, [asset("NIM", 0.5), asset("NIM", 12.3456), asset("USDT", 12.345), asset("BTC", 0.000123456789), asset("ETH", 1.23456789), asset("NIM", 2642217.35), asset("USDT", 1234567.89), asset("NIM", 999999999.0)])
    assert list(got) == ["≈ 0.5000", "≈ 12.35", "≈ 12.35", "≈ 0.00012346", "≈ 1.234568", "≈ 2,642,217.35 (2.64M)", "≈ 1,234,567.89", "≈ 999,999,999.00 (1B)"]
    rate = lambda a, x: money.rate_text(F.lit(a), F.lit(float(x)))
    got = one(spark, [money.nim_text(F.lit(100.0)), rate("NIM", 0.00043422), rate("BTC", 55675), rate("USDT", 0.92), rate("USDT", 1.2345), rate("NIM", 0.0123), money.fiat_text(F.lit("JPY"), F.lit(1500.5)), money.fiat_text(F.lit("EUR"), F.lit(0.125))])
    assert list(got) == ["100.00", "0.000434", "55,675", "0.92", "1.2345", "0.0123", "1,501", "0.13"]


def test_money_rules(spark):
    unknown, enough, short = (money.affordability(F.lit(b).cast("double"), F.lit(10.0)) for b in (None, 100, 5))
    got = one(spark, [*unknown, *enough, *short, money.luna_to_nim(F.lit(12345000)), money.nim_to_luna(F.lit(1.000005)), money.asset_amount(F.lit(10.0), F.lit(0.5)), money.asset_amount(F.lit(1.0), F.lit(0.0)), money.tip_luna(F.lit(0.0)), money.tip_luna(F.lit(2.5))])
    assert list(got) == [None, None, True, 0.0, False, 5.0, 123.45, 100001, 20.0, None, None, 250000]
    address = "NQ07 0000 0000 0000 0000 0000 0000 0000 0000"
    got = one(spark, [money.is_address(F.lit(f" {address.lower()} ")), money.is_address(F.lit("NQ07 0000")), money.short_address(F.lit(address)), money.short_address(F.lit("NQ07")), money.age_text(F.lit(0), F.lit(59999)), money.age_text(F.lit(0), F.lit(185000)), money.age_text(F.lit(9), F.lit(0))])
    assert list(got) == [True, False, "NQ07 **** **** 0000", "NQ07", "59s", "3m", "0s"]


BOXES = {
    "split": ([("$", 80, 80, 0, 0, 8, 20), ("299", 90, 92, 10, 0, 40, 30), ("95", 85, 88, 55, 2, 16, 14)], None, {(299.95, "USD")}),
    "euro": ([("€", 80, 80, 0, 0, 8, 20), ("3", 90, 92, 10, 0, 20, 30), ("99", 85, 88, 34, 2, 16, 14)], "EUR", {(3.99, "EUR")}),
    "raised": ([("€", 80, 80, 0, 12, 8, 20), ("3", 96, 96, 12, 10, 24, 28), ("9", 84, 84, 64, 4, 18, 12), ("9", 84, 84, 84, 4, 18, 12)], "EUR", {(3.99, "EUR")}),
    "conflict": ([("$", 80, 0, 0, 0, 12, 20), ("8", 90, 90, 80, 0, 16, 20), ("32", 90, 90, 100, 0, 24, 20)], "EUR", set()),
    "isolated": ([("$", 80, 80, 0, 0, 8, 20), ("299", 90, 92, 10, 0, 40, 30), ("95", 85, 88, 55, 2, 16, 14), ("$900", 88, 90, 120, 0, 50, 30)], "USD", {(299.95, "USD"), (900.0, "USD")}),
}


def test_candidates_of_fragments(spark):
    rows = [(n, 0, 0, k, *f, scan) for n, (boxes, scan, _) in enumerate(BOXES.values()) for k, f in enumerate(boxes)]
    table = spark.createDataFrame(rows, "image_id long, crop_idx int, variant_idx int, frag_idx int, text string, confidence int, digit_confidence int, x int, y int, width int, height int, scan string")
    found = fragments.with_distance(fragments.candidates(table, F.col("scan")), F.lit(100.0), F.lit(40.0))
    got = found.collect()
    for n, (_, _, want) in enumerate(BOXES.values()):
        mine = {(r.amount, r.currency) for r in got if r.image_id == n}
        assert want <= mine and (want or not mine)
    marks = {r.amount: (r.suspicious, r.split) for r in got if r.image_id == 4}
    assert marks[299.95] == (False, True) and marks[900.0] == (True, False)
    chosen = {r.image_id: r.amount for r in fragments.best(found.withColumn("distance", F.lit(5.0))).collect()}
    assert chosen[2] == 3.99 and chosen[4] == 299.95
    assert fragments.candidates(table.limit(0), F.col("scan")).count() == 0


READS = [(0, 0, "no price", 90, 0, 0), (0, 1, "€12.99", 70, 88, 0), (1, 0, "€3.99", 80, 95, 0), (1, 1, "€1.00", 60, 50, 0)]
NOISY = [(0, 0, "- I B\nEILLIGS\n1 BE\nRR . 5199\nAr, 87 2.06\n", 27, 96, 0), (1, 0, "1.99\n- ¥ - .\n", 60, 78, 0)]
LARGE = [(0, 0, "2.06", 88, 93, 200), (1, 0, "1.99", 75, 82, 3240)]


@pytest.mark.parametrize("reads,want", [(READS, (1, 0, 3.99)), (NOISY, (1, 0, 1.99)), (LARGE, (1, 0, 1.99))])
def test_winner_of_whole_readings(spark, reads, want):
    table = spark.createDataFrame([(1, *r) for r in reads], "image_id long, crop_idx int, variant_idx int, text string, confidence int, digit_confidence int, digit_area int")
    out = fragments.whole_variants(table, F.lit("EUR"))
    (winner,) = fragments.winners(out).collect()
    assert (winner.crop_idx, winner.variant_idx, winner.amount) == want
    assert fragments.summary(out).first().n_rejected == sum(r.rejected for r in out.collect())


def test_geometry(spark):
    box = lambda x, y, w, h: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height"))
    got = one(spark, [geometry.related(box(10, 10, 40, 30), box(55, 12, 16, 14)), geometry.related(box(0, 0, 10, 10), box(35, 0, 5, 5)), frames.to_gray(F.lit(255), F.lit(0), F.lit(0)), *geometry.padded(box(1, 5, 10, 50), F.lit(60), F.lit(50)).values()])
    assert list(got) == [True, False, 76, 0, 3, 14, 47]
    crops = frames.crops(spark.createDataFrame([(1, 1920, 1080), (2, 800, 600), (3, 2000, 900), (4, 736, 734)], "image_id long, width int, height int"))
    first = {r.image_id: (r.x, r.y, r.width, r.height) for r in crops.where("crop_idx = 0").collect()}
    assert first == {1: (240, 351, 1440, 378), 2: (100, 221, 600, 158), 3: (400, 293, 1200, 315), 4: (92, 295, 552, 145)}
    assert frames.focused(crops).count() == 24


def flood(mask):
    height, width = mask.shape
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        stack = [start]
        while stack:
            y, x = stack.pop()
            if 0 <= y < height and 0 <= x < width and mask[y, x] and not out[y, x]:
                out[y, x] = n
                stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return out


def test_components_equal_a_flood_fill():
    rng = np.random.default_rng(2)
    for _ in range(200):
        mask = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < rng.uniform(0.2, 0.9)
        assert (frames.component_labels(mask) == flood(mask)).all()


def plain_regions(gray, least, threshold=128):
    dark = gray < threshold
    n = int(dark.sum())
    labels = flood(dark if n and (n == gray.size or n <= gray.size - n) else ~dark)
    out = []
    for k in range(1, labels.max() + 1):
        y, x = np.nonzero(labels == k)
        if len(x) >= least:
            out.append((int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1, round(float(x.mean()), 6), round(float(y.mean()), 6), len(x)))
    return out


def region_rows(found, *more):
    return [(*(r[c] for c in more), r.region_idx, r.x, r.y, r.width, r.height, round(r.center_x, 6), round(r.center_y, 6), r.area) for r in found]


def spiral(side):
    """One winding path that crosses every seam of any tiles many times."""
    out = np.full((side, side), 255)
    low, high, at = 0, side - 1, 0
    while low <= high:
        out[low, max(0, low - 2) : high + 1] = out[low : high + 1, high] = out[high, low : high + 1] = at
        out[low + 2 : high + 1, low] = at
        low, high = low + 2, high - 2
    return out


@pytest.mark.parametrize("tile", [1000, 24, 7])
def test_regions_of_tiles_equal_a_flood_fill(spark, tile):
    rng = np.random.default_rng(12)
    frames_of = [(k, (rng.random((rng.integers(1, 50), rng.integers(1, 50))) < rng.uniform(0.3, 0.7)) * 255) for k in range(8)]
    frames_of += [(100, spiral(49)), (101, np.zeros((30, 30))), (102, np.full((30, 31), 255)), (103, (np.indices((40, 40)).sum(0) % 2) * 255)]
    rows = [(k, m.shape[1], m.shape[0], m.astype(int).ravel().tolist()) for k, m in frames_of] + [(200, 9, 9, [0] * 80), (201, 0, 0, []), (202, 5, 5, None)]
    table = spark.createDataFrame(rows, "frame_id long, width int, height int, gray array<int>").repartition(3)
    got = region_rows(frames.regions(table, 3, tile=tile).collect(), "frame_id")
    want = [(k, n, *r) for k, m in frames_of for n, r in enumerate(plain_regions(m, 3))]
    assert sorted(got) == sorted(want)


def test_a_frame_in_one_four_and_sixteen_tiles(spark):
    rng = np.random.default_rng(13)
    side = 2000
    noise = (rng.random((side, side)) < 0.45) * 255
    noise[::200] = 255
    noise[700:1300, 700:1300] = spiral(600)
    table = spark.createDataFrame([(1, side, side, noise.astype(np.int32).ravel().tolist())], "frame_id long, width int, height int, gray array<int>").cache()
    found = [sorted(region_rows(frames.regions(table, 20, tile=tile).collect(), "frame_id")) for tile in (2000, 1000, 500)]
    assert len(found[0]) > 100 and found[0] == found[1] == found[2]


def test_histograms_need_no_shuffle(spark):
    table = spark.createDataFrame([(1, [0, 0, 255, 7]), (2, []), (3, None)], "frame_id long, gray array<int>")
    got = {r.frame_id: r.counts for r in frames.histogram(table).collect()}
    assert got[1][0] == 2 and got[1][7] == got[1][255] == 1 and len(got[1]) == 256 and sum(got[2]) == sum(got[3]) == 0
    out = frames.otsu(frames.histogram(table))
    assert {r.frame_id: r.threshold for r in out.collect()} == {1: 7, 2: 128, 3: 128}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_thresholds_in_columns_and_in_numpy_agree(spark):
    rng = np.random.default_rng(14)
    rows = [(k, rng.integers(0, rng.integers(1, 257), rng.integers(1, 400)).tolist()) for k in range(60)]
    got = {r.frame_id: r.threshold for r in frames.otsu(frames.histogram(spark.createDataFrame(rows, "frame_id long, gray array<int>"))).collect()}
    for k, gray in rows:
        assert got[k] == frames._best_level(frames.counts_of(np.array(gray)))


def test_pictures_give_the_regions_of_all_variants(spark):
    """A crop of 300 x 100 and more has 15 variants, a smaller one five; each equals its own pixels cut out, changed, drawn twice as large and flooded."""
    rng = np.random.default_rng(15)
    large = np.repeat(np.repeat(rng.integers(0, 256, (36, 64)), 8, 0), 8, 1)
    small = rng.integers(0, 256, (40, 60))
    rows = [(1, 512, 288, large.ravel().tolist()), (2, 60, 40, small.ravel().tolist()), (3, 10, 10, [1]), (4, 10, 10, None)]
    table = spark.createDataFrame(rows, "image_id long, width int, height int, gray array<int>")
    got = frames.picture_regions(table, 40).collect()
    by = {}
    for r in got:
        by.setdefault((r.image_id, r.crop_idx, r.variant_idx), []).append(r)
    crops = {(r.image_id, r.crop_idx): r for r in frames.crops(table.where("image_id < 3")).collect()}
    focus = {(r.image_id, r.crop_idx, r.focus_idx): r for r in frames.focused(frames.crops(table.where("image_id < 3"))).collect()}
    assert {k[:2] for k in focus} == {(1, 0), (1, 1), (1, 2)} and {k[2] for k in by if k[0] == 1} == set(range(15)) and {k[2] for k in by if k[0] == 2} == set(range(5))
    for image, pixels in ((1, large), (2, small)):
        for crop in (0, 2) if image == 2 else (1,):
            c = crops[image, crop]
            views = [pixels[c.y : c.y + c.height, c.x : c.x + c.width]]
            views += [views[0][f.fy : f.fy + f.fh, f.fx : f.fx + f.fw] for f in (focus[image, crop, n] for n in (0, 1))] if image == 1 else []
            for n, view in enumerate(views):
                auto = frames._best_level(frames.counts_of(view.ravel()))
                for mode, changed in enumerate((view, *(np.where(view >= t, 255, 0) for t in (128, 160, auto)), np.where(view >= auto, 0, 255))):
                    if n == 0 or mode in (0, 4):
                        drawn = np.repeat(np.repeat(changed, 2, 0), 2, 1)
                        own = by.get((image, crop, 5 * n + mode), [])
                        assert all((r.variant_width, r.variant_height) == drawn.shape[::-1] for r in own)
                        assert sorted(region_rows(own)) == sorted((k, *r) for k, r in enumerate(plain_regions(drawn, 40)))


def plain_clusters(boxes):
    """The rule as it is said: every box is compared with every member of every cluster."""
    order = sorted(range(len(boxes)), key=lambda k: (boxes[k][0], boxes[k][1]))
    out = []
    for k in order:
        x, y, w, h = boxes[k]
        near = [m for m in out if any(max(0, boxes[o][0] - (x + w), x - (boxes[o][0] + boxes[o][2])) <= 24 and max(0, boxes[o][1] - (y + h), y - (boxes[o][1] + boxes[o][3])) <= 32 for o in m)]
        near[0].append(k) if near else out.append([k])
    return out


def clusters_of(boxes):
    labels = fragments.cluster_labels(np.zeros(len(boxes), int), np.asarray(boxes, float))
    return [sorted(np.flatnonzero(labels == k).tolist()) for k in range(labels.max() + 1)]


def test_greedy_clusters():
    assert clusters_of([[10, 10, 40, 30], [55, 12, 16, 14]]) == [[0, 1]]
    assert clusters_of([[0, 0, 10, 10], [60, 0, 10, 10], [30, 0, 10, 10]]) == [[0, 1, 2]]
    assert clusters_of([[0, 0, 10, 10], [10, 100, 10, 10], [15, 60, 10, 10]]) == [[0], [1, 2]]
    rng = np.random.default_rng(3)
    for n in (1, 2, 40, 150):
        for spread in (100, 600, 2000):
            boxes = np.c_[rng.integers(0, spread, (n, 2)), rng.integers(0, 40, (n, 2)) ** rng.integers(1, 3, (n, 1))].astype(float)
            assert clusters_of(boxes) == [sorted(m) for m in plain_clusters(boxes.tolist())]


def test_clusters_of_a_large_variant_take_seconds():
    rng = np.random.default_rng(4)
    boxes = np.c_[rng.integers(0, 20000, (50_000, 2)), rng.integers(2, 40, (50_000, 2))].astype(float)
    began = time.process_time()
    labels = fragments.cluster_labels(np.zeros(len(boxes), int), boxes)
    assert time.process_time() - began < 10 and 1 < labels.max() < len(boxes)


def plain_offers(page, integer, atomic, cents, digit):
    n = len(page.x)
    one = lambda k: np.array([k])
    near, isolated, first, second = [-1] * n, [False] * n, [-1] * n, [-1] * n
    for i in range(n):
        mine = [j for j in range(n) if page.group[j] == page.group[i]]
        close = [c for c in mine if cents[c] and page.related(one(i), one(c))[0]] if integer[i] else []
        isolated[i] = bool(close)
        if integer[i] and not atomic[i]:
            near[i] = min([(page.x[c], c) for c in close if page.x[c] >= page.x[i] - 8], default=(0, -1))[1]
            placed = sorted((page.x[d], d) for d in mine if digit[d] and page.above(one(i), one(d))[0])
            for (_, d), (_, e) in zip(placed, placed[1:]):
                if page.related(one(i), one(d), 36)[0] and page.related(one(d), one(e))[0]:
                    first[i], second[i] = d, e
                    break
    return near, isolated, first, second


def page_of(rng, n, side, groups=1):
    return spatial.Page(np.sort(rng.integers(0, groups, n)), *(rng.integers(0, side, (2, n)) * 1.0), *(rng.integers(1, 60, (2, n)) * 1.0))


@pytest.mark.parametrize("side", [60, 200, 900])
def test_offers_equal_all_pairs(side):
    rng = np.random.default_rng(side)
    for _ in range(12):
        page = page_of(rng, 60, side, 3)
        page.x[rng.integers(0, 60)] = np.nan
        kinds = rng.random((4, 60)) < 0.4
        integer, atomic, cents, digit = kinds
        near, isolated, first, second = plain_offers(page, *kinds)
        got_near, got_isolated = page.cents(integer, integer & ~atomic, cents)
        got_first, got_second = page.raised(integer & ~atomic, digit)
        assert got_near.tolist() == near and (integer & got_isolated).tolist() == isolated
        assert got_first.tolist() == first and got_second.tolist() == second


def test_pairs_tried_follow_the_fragments():
    """Pages of one density: ten times the words, about ten times the pairs."""
    tried = []
    for n in (1000, 10_000):
        rng = np.random.default_rng(7)
        page = page_of(rng, n, int(60 * n**0.5))
        integer, cents, digit = rng.random(n) < 0.5, rng.random(n) < 0.3, rng.random(n) < 0.3
        page.cents(integer, integer, cents)
        page.raised(integer, digit)
        tried.append(page.tried)
    assert tried[1] < 20 * tried[0] and tried[1] < 0.02 * 10_000**2


def test_pairs_of_very_different_sizes_meet_once():
    rng = np.random.default_rng(8)
    for _ in range(20):
        boxes = [grid.Boxes.of(rng.integers(0, 2, n), *(rng.integers(-500, 500, (2, n)) * 1.0), *(2.0 ** rng.integers(0, 11, (2, n)))) for n in (50, 70)]
        a, b = boxes
        got = [p for part in grid.near_pairs(a, b, (24.0, 32.0)) for p in zip(*(x.tolist() for x in part))]
        want = {(i, j) for i in range(50) for j in range(70) if a.group[i] == b.group[j] and a.x0[i] <= b.x1[j] and b.x0[j] <= a.x1[i] and a.y0[i] <= b.y1[j] and b.y0[j] <= a.y1[i]}
        assert len(got) == len(set(got)) and want <= set(got)


def test_frames(spark):
    checker = [255 * ((x + y) % 2) for y in range(24) for x in range(32)]
    data = [(1, 7, 1, 32, 24, checker), (2, 7, 2, 32, 24, [255 - v for v in checker]), (3, 8, 1, 32, 24, [128] * 768), (4, 9, 1, 4, 2, [0, 0, 0, 255, 9, 9, 255, 255]), (5, 9, 2, 0, 0, [])]
    table = spark.createDataFrame(data, "frame_id long, session_id long, seq long, width int, height int, gray array<int>")
    got = {r.frame_id: r for r in frames.quality(table).collect()}
    assert [got[i].reason for i in (1, 2, 3, 4)] == [None, "motion", "blur", "blur"] and got[2].motion == 255
    cut = {r.frame_id: r.threshold for r in frames.otsu(frames.histogram(table)).collect()}
    assert (cut[1], cut[3], cut[4]) == (0, 128, 9)
    regions = frames.regions(spark.createDataFrame([(1, 20, 10, [0 if (x, y) in {(2, 2), (3, 2), (4, 2), (2, 3), (3, 3), (4, 3), *((x, 4) for x in range(12, 17))} else 255 for y in range(10) for x in range(20)])], "frame_id long, width int, height int, gray array<int>"), 4)
    assert [(r.area, r.x, r.y, r.width, r.height) for r in regions.orderBy("region_idx").collect()] == [(6, 2, 2, 3, 2), (5, 12, 4, 5, 1)]


def test_stable_prices_follow_the_tracker(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for s in range(60):
        pending = None
        for k in range(40):
            price = rng.choice([None, (1.0, "EUR"), (1.0, "USD"), (2.0, "EUR")]) if rng.random() < 0.5 else (1.0, "EUR")
            rows.append((s, k, k, *(price or (None, None))))
            if price and price == pending:
                want.add((s, k))
                price = None
            pending = price
    table = spark.createDataFrame(rows, "session_id long, seq long, ts long, amount double, currency string")
    assert {(r.session_id, r.seq) for r in readings.stable(table).collect()} == want
    first = {r.session_id: r.seq for r in readings.first_stable(readings.stable(table)).collect()}
    assert first == {s: min(k for t, k in want if t == s) for s, _ in want}


def test_long_sessions_are_carried_over_buckets(spark):
    """Sessions cut into buckets of 1 to many readings, with runs over several of them, confirm what whole sessions do."""
    rng = random.Random(9)
    rows, at = [], 0
    for s in range(12):
        price, at = None, 0
        for k in range(300):
            at += rng.choice([0, 1, 1, 2, 30])
            if rng.random() < 0.15:
                price = rng.choice([None, (1.0, "EUR"), (1.0, None), (2.0, "EUR")])
            rows.append((s if s else None, k, at, *(price or (None, None))))
    table = spark.createDataFrame(rows, "session_id long, seq long, ts long, amount double, currency string").where("session_id is not null").cache()
    want = sorted((r.session_id, r.seq) for r in readings.stable(table, 10**9).collect())
    for seconds in (1, 3, 20, 500):
        assert sorted((r.session_id, r.seq) for r in readings.stable(table, seconds).collect()) == want
    plain = []
    for s in range(1, 12):
        pending = None
        for _, k, _, amount, currency in (r for r in rows if r[0] == s):
            price = None if amount is None else (amount, currency)
            if price and price == pending:
                plain.append((s, k))
                price = None
            pending = price
    assert want == sorted(plain)


def test_cache_replay_follows_the_cache(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(40):
        now, at, served = 0, None, None
        for k in range(60):
            now += rng.choice([1, 5, 20, 60, 61])
            ok = rng.random() < 0.6
            rows.append((i, k, now, ok))
            if at is not None and now - at < 60:
                status = "cached"
            elif ok:
                status, at, served = "fetched", now, k
            else:
                status = "error" if at is None else "stale"
            want[i, k] = (status, served)
    table = spark.createDataFrame(rows, "instance_id long, seq long, s long, fetch_ok boolean").withColumn("ts", F.timestamp_seconds("s"))
    assert {(r.instance_id, r.seq): (r.status, r.served_seq) for r in rates.replay(table, 60).collect()} == want


def test_richest_account(spark):
    rows = [(1, 0, "a", 0), (1, 1, "b", 100_100_000), (2, 0, "c", 5), (2, 1, "d", 5), (3, 0, "e", None), (3, 1, "f", None), (4, 0, "g", None), (4, 1, "h", 0)]
    got = {r.wallet_id: (r.account_index, r.balance_nim) for r in wallets.richest(spark.createDataFrame(rows, "wallet_id long, account_index int, address string, luna long")).collect()}
    assert got == {1: (1, 1001.0), 2: (0, 0.00005), 3: (0, None), 4: (1, 0.0)}


def test_payloads(spark):
    raw = spark.createDataFrame([(1, '{"result": {"data": {"address": "A", "balance": 12345000}}}'), (2, '{"error": {"message": "Invalid address"}}'), (3, "{}"), (4, "junk"), (5, None)], "i int, payload string")
    got = {r.i: (r.status, r.luna) for r in feeds.parse_accounts(raw).collect()}
    assert got == {1: ("ok", 12345000), 2: ("Invalid address", None), 3: ("no result", None), 4: ("no result", None), 5: ("no result", None)}


VALID = "NQ07 0000 0000 0000 0000 0000 0000 0000 0001"


def test_stored_wallets(spark):
    raw = [
        (1, '{"address": "%s", "balanceNim": 12.5, "updatedAt": 1700000000000}' % VALID, (VALID, 12.5, 1700000000000)), (2, VALID, (VALID, None, 0)), (3, '{"address": "A1", "balanceNim": 1}', (None, None, None)),
        (4, '{"address": "%s", "balanceNim": "12", "updatedAt": "1700"}' % VALID, (VALID, None, 0)), (5, '{"x": {"address": "%s"}}' % VALID, (None, None, None)), (6, "junk", (None, None, None)), (7, None, (None, None, None)),
        (8, '{"address": 7}', (None, None, None)), (9, '{"address": "%s", "balanceNim": null}' % VALID, (VALID, None, 0)), (10, '"%s"' % VALID, (None, None, None)), (11, f" {VALID.lower()} ", (f" {VALID.lower()} ", None, 0)), (12, "[1]", (None, None, None)),
    ]
    got = feeds.parse_wallets(spark.createDataFrame([r[:2] for r in raw], "i int, raw string")).collect()
    assert {r.i: (r.address, r.balance_nim, r.updated_at) for r in got} == {i: want for i, _, want in raw}


def test_stored_preferences(spark):
    raw = [
        (1, '{"fiatCurrency": "CHF", "onboardingComplete": true}', ("CHF", True)), (2, '{"fiatCurrency": "XXX", "onboardingComplete": true}', ("EUR", False)), (3, '{"fiatCurrency": "JPY", "onboardingComplete": "true"}', ("JPY", False)),
        (4, '{"fiatCurrency": "JPY", "x": {"onboardingComplete": true}}', ("JPY", False)), (5, '{"onboardingComplete": true}', ("EUR", False)), (6, "junk", ("EUR", False)), (7, None, ("EUR", False)), (8, '{"fiatCurrency": 5, "onboardingComplete": true}', ("EUR", False)),
    ]
    got = feeds.parse_preferences(spark.createDataFrame([r[:2] for r in raw], "i int, raw string")).collect()
    assert {r.i: (r.fiat, r.onboarded) for r in got} == {i: want for i, _, want in raw}


REPORT = """{
  "input": "fixtures/example.jpg", "currency": "EUR",
  "crops": [{"index": 0, "rect": {"x": 0, "y": 5, "width": 100, "height": 50}, "variants": [
    {"index": 0, "mode": "grayscale", "text": " €3.99\\n", "confidence": 80, "digitConfidence": 95, "parsed": {"amount": 3.99, "currency": "EUR"}, "score": 95080, "rejected": false, "regionCount": 2, "candidateCount": 1},
    {"index": 1, "mode": "threshold:128", "text": "noise", "confidence": 70, "digitConfidence": 0, "parsed": null, "score": null, "rejected": true}]}],
  "winner": {"cropIndex": 0, "variantIndex": 0, "parsed": {"amount": 3.99, "currency": "EUR"}}
}"""


def test_reports_in_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(REPORT)
    (tmp_path / "b.json").write_text('{"input": "none.jpg", "currency": "USD", "crops": [], "winner": null}')
    found = feeds.read_reports(spark, f"file://{tmp_path}/*.json")
    summed = {r.input: tuple(r)[1:] for r in feeds.summarise_reports(found).collect()}
    assert summed == {"fixtures/example.jpg": ("EUR", "3.99 EUR", "€3.99", 2, 1, 1), "none.jpg": ("USD", "none", "n/a", 0, 0, 0)}
    rows = feeds.explode_reports(found)
    want = [("fixtures/example.jpg", "EUR", 0, (0, 5, 100, 50), 0, "grayscale", " €3.99\n", 80.0, 95.0, 3.99, "EUR", 95080.0, False, 2, 1), ("fixtures/example.jpg", "EUR", 0, (0, 5, 100, 50), 1, "threshold:128", "noise", 70.0, 0.0, None, None, None, True, None, None)]
    assert sorted(map(tuple, rows.collect()), key=lambda r: r[4]) == want
    winners = spark.createDataFrame([("fixtures/example.jpg", 0, 0, 3.99, "EUR")], "input string, crop_idx int, variant_idx int, amount double, currency string")
    out = f"file://{tmp_path}/out"
    feeds.write_reports(feeds.build_reports(rows, winners), out)
    again = feeds.read_reports(spark, out, lines=True)
    assert again.collect() == found.where("size(crops) > 0").collect()
    with pytest.raises(Exception, match="already exists"):
        feeds.write_reports(again, out)


def test_reports_that_do_not_parse(spark, tmp_path):
    bad = {"a": REPORT, "b": REPORT[:-40], "c": "", "d": '{"x": 1}', "e": REPORT.replace('"crops": [', '"crops": 7, "y": ['), "f": "[]"}
    for name, text in bad.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = feeds.read_reports(spark, f"file://{tmp_path}/*.json")
    said = sorted(re.sub(r"\S*/", "", r.error or "") for r in found.collect())
    assert said == ["", "bad report in b.json", "bad report in e.json", "no input in d.json"]
    assert {r.input for r in feeds.explode_reports(found).collect()} == {"fixtures/example.jpg"}
    assert [r.input for r in feeds.summarise_reports(found).collect()] == ["fixtures/example.jpg"]
    out = f"file://{tmp_path}/lines"
    feeds.write_reports(found, out)
    assert feeds.read_reports(spark, out, lines=True).collect() == found.where("error is null").collect()


def test_complete_snapshots_and_stale_rates(spark):
    full = {feed: {f.lower(): 2.0 for f in FIATS} for _, feed in ASSETS}
    short = {**full, "tether": {"eur": 1.0}}
    raw = feeds.parse_feeds(spark.createDataFrame([(1, json.dumps(full)), (2, json.dumps(short)), (3, "junk"), (4, None), (5, "{}")], "snapshot_id long, payload string"))
    got = rates.normalise(raw).collect()
    assert {r.snapshot_id for r in got} == {1} and len(got) == 40
    ticks = [("NIM", "EUR", at, k, 1.0 + k, flag) for k, (at, flag) in enumerate([("2024-01-01 00:00:00", False), ("2024-01-01 00:10:00", False)])]
    ticks += [("BTC", "EUR", "2024-01-01 00:05:00", 9, 5.0, False), ("ETH", "EUR", "2024-01-01 00:10:00", 10, 6.0, True), ("USDT", "EUR", "2024-01-01 00:04:59", 11, 7.0, None)]
    table = spark.createDataFrame(ticks, "asset string, fiat string, ts string, event_id long, rate double, stale boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.asset: (r.rate, r.age_s, r.stale, r.usable) for r in rates.latest(table, F.max("ts")).collect()}
    assert got == {"NIM": (2.0, 0.0, False, True), "BTC": (5.0, 300.0, False, True), "ETH": (6.0, 0.0, True, True), "USDT": (7.0, 301.0, True, False)}


def test_words_of_a_page(spark):
    page = '{"blocks": [{"paragraphs": null}, {"paragraphs": [{"lines": [{"words": [{"text": "€12", "confidence": 92.0, "bbox": {"x0": 0, "y0": 0, "x1": 60, "y1": 30}}, {"text": "ab", "confidence": 99.0}]}, {"words": null}]}]}]}'
    pages = spark.createDataFrame([(1, page)], "i int, j string").select("i", F.from_json("j", feeds.PAGE).alias("page"))
    words = feeds.flatten_words(pages)
    assert [(r.block, r.word, r.text) for r in words.collect()] == [(1, 0, "€12"), (1, 1, "ab")]
    assert feeds.digit_words(words, ["i"]).first()[1:] == (92.0, 1800.0)


def test_streams_over_many_batches(spark, tmp_path):
    """State is read back from batch to batch: one file a batch must equal the batch form."""
    import pandas as pd

    from fiatscan.streaming import runner, stateful

    rng = random.Random(12)
    amounts = [rng.choice([1.5, 2.5, None]) for _ in range(240)]
    rows = pd.DataFrame({"session_id": [rng.randint(0, 3) for _ in amounts], "seq": range(240), "ts": pd.date_range("2024-01-01", periods=240, freq="s"), "amount": amounts, "currency": ["EUR" if a else None for a in amounts]})
    rows["instance_id"], rows["fetch_ok"] = rows["session_id"], [rng.random() < 0.6 for _ in amounts]
    rows["frame_id"], rows["width"], rows["height"] = rows["seq"], 4, 4
    rows["gray"] = [[rng.randint(0, 255) for _ in range(16)] for _ in amounts]
    (tmp_path / "t.parquet").mkdir()
    for k in range(4):
        rows.iloc[60 * k : 60 * k + 60].to_parquet(tmp_path / f"t.parquet/part-{k}.parquet", coerce_timestamps="us")
    table = spark.read.parquet(f"{tmp_path}/t.parquet")
    stream = runner.read_stored(spark, str(tmp_path), "t", max_files=1)
    pairs = [
        (stateful.stable_prices(stream), readings.stable(table).select("session_id", "seq", "amount", "currency")),
        (stateful.cache_replay(stream, 5), rates.replay(table, 5)),
        (stateful.frame_gate(stream.withColumns({c: F.col(c).cast("int") for c in ("width", "height")}).withColumn("gray", F.col("gray").cast("array<int>"))), frames.quality(table.withColumns({c: F.col(c).cast("int") for c in ("width", "height")}))),
    ]
    for streamed, want in pairs:
        got = runner.drain(streamed, "many")
        plain = lambda df: sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in df.select(*want.columns).collect())
        assert plain(got) == plain(want) and plain(want)


def test_recogniser_hook(spark):
    from fiatscan.streaming import stateful

    def upper(batches):
        for pdf in batches:
            yield pdf.assign(text=pdf["text"].str.upper())

    got = stateful.recognised(spark.createDataFrame([("a",)], "text string"), upper, "text string").first()
    assert got.text == "A"


def test_image_files(spark, tmp_path):
    import struct

    from fiatscan.sources import images

    rows = b"".join(b"\x00\x00\xff" * 2 + b"\x00\x00" for _ in range(2))  # red, rows padded to four bytes
    head = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, len(rows), 2835, 2835, 0, 0)
    (tmp_path / "red.bmp").write_bytes(head + rows)
    (tmp_path / "junk.bmp").write_bytes(b"no image")
    (frame,) = images.read_frames(spark, f"file://{tmp_path}").collect()
    assert (frame.width, frame.height, frame.gray) == (2, 2, [76, 76, 76, 76])


def test_words_meet_readings_like_plain_search():
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("ab1 \n") for _ in range(draw.randrange(n)))
    met = 0
    for _ in range(400):
        winner = text(12)
        words, tokens = held.Words(winner), winner.split()
        for reading in [text(9) for _ in range(20)] + ["", " ", "\t"]:
            want = any(t in reading or reading.strip() in t for t in tokens)
            assert words.meet(reading) is want, (winner, reading)
            met += want
    assert met > 500 and not held.Words(None).meet("a") and not held.Words("a").meet(None)


def test_words_meet_readings_in_linear_time():
    def took(n):
        began = time.process_time()
        words = held.Words(" ".join(f"{k:06d}" for k in range(n)))
        assert sum(words.meet(f"x{k}y") or words.meet(str(k)) for k in range(n)) > n // 2
        return time.process_time() - began

    took(500)
    assert took(32_000) < 24 * took(4_000) + 0.5


def test_digit_areas(spark):
    fields = "image_id long, crop_idx int, variant_idx int, frag_idx int, text string, digit_area int"
    reads = [(1, 0, 0, 0, "€12", 50), (1, 0, 0, 1, "99 cents", 70), (1, 0, 0, 2, "zzz", 900), (1, 0, 0, 3, None, 900), (1, 0, 1, 0, "12", 500), (2, 0, 0, 0, " ", 30), (2, 0, 0, 1, "x", 400), (3, 0, 0, 0, "x", 5), (4, 0, 0, 0, "12", None)]
    found = [(1, 0, 0, "12 99", 3, 4), (2, 0, 0, "5", 3, 4), (3, 0, 0, "7", 3, 4), (4, 0, 0, "12", 3, 4), (5, 0, 0, "12", 3, 4)]
    winners = spark.createDataFrame(found, "image_id long, crop_idx int, variant_idx int, text string, width int, height int")
    got = fragments.digit_area(winners, spark.createDataFrame(reads, fields).repartition(3)).collect()
    assert {r.image_id: r.area for r in got} == {1: 70, 2: 30, 3: 12, 4: 12, 5: 12} and got[0].asDict().keys() == {*winners.columns, "area"}
    assert fragments.digit_area(winners.limit(0), spark.createDataFrame(reads, fields)).count() == 0


def page_of(*lines):
    """A tree of words, a paragraph of lines of (text, confidence)."""
    words = lambda line: [{"text": t, "confidence": float(c), "bbox": {"x0": 0.0, "y0": 0.0, "x1": 10.0, "y1": 5.0}} for t, c in line]
    return {"blocks": [{"paragraphs": None}, {"paragraphs": [{"lines": [{"words": words(line)} for line in lines]}]}]}


def test_from_words_to_the_winner(spark):
    schema = f"image_id long, crop_idx int, variant_idx int, region_idx int, x int, y int, width int, height int, confidence double, page {feeds.PAGE}"
    whole = lambda image, crop, variant, confidence, *lines: (image, crop, variant, None, None, None, None, None, confidence, page_of(*lines))
    rows = [whole(1, 0, 0, 90.0, [("no", 90)]), whole(1, 0, 1, 70.0, [("€12.99", 88)]), whole(1, 1, 0, 80.0, [("€3.99", 95)]), whole(1, 1, 1, 60.0, [("€1.00", 50)])]
    rows += [whole(2, 0, 0, 85.0, [("SPECIAL", 85)]), whole(2, 0, 1, 40.0, [("12.99", 55)]), (3, 0, 0, None, None, None, None, None, 5.0, None), (3, 0, 1, None, None, None, None, None, 5.0, {"blocks": []})]
    parts = [(0, "$", 10, 20, 12, 30, 60), (1, "299", 26, 10, 60, 40, 92), (2, "95", 92, 10, 20, 18, 90)]
    rows += [(4, 0, 0, k, x, y, w, h, 80.0, page_of([(text, c)])) for k, text, x, y, w, h, c in parts]
    pages = spark.createDataFrame(rows, schema)
    args = (F.lit("EUR"), F.lit(400.0), F.lit(60.0))
    got = {(r.image_id, r.crop_idx, r.variant_idx): r for r in scan.results(pages.where("image_id < 4"), *args).collect()}
    assert len(got) == 8 and got[2, 0, 0].rejected and (got[2, 0, 0].text, got[2, 0, 0].digit_confidence) == ("SPECIAL", 0)
    assert got[2, 0, 1].rejected and got[2, 0, 1].digit_confidence == 55 and got[3, 0, 0].text == got[3, 0, 1].text == ""
    images = {r.image_id: r for r in scan.images(pages.where("image_id < 4"), *args).collect()}
    assert (images[1].crop_idx, images[1].variant_idx, images[1].amount, images[1].currency, images[1].text) == (1, 0, 3.99, "EUR", "€3.99")
    assert images[2].amount is None and images[2].n_rejected == 2 and images[3].n_rejected == 2
    (tag,) = scan.images(pages.where("image_id = 4"), F.lit("USD"), F.lit(400.0), F.lit(60.0)).collect()
    assert (tag.amount, tag.currency, tag.n_accepted, tag.n_regions) == (299.95, "USD", 1, 3)
    assert scan.images(pages.limit(0), *args).count() == 0
    lines = scan.readings(spark.createDataFrame([(1, page_of([("1", 9), ("a", 99)], [("b", 99)]))], f"k int, page {feeds.PAGE}")).first()
    assert (lines.text, lines.digit_confidence, lines.digit_area) == ("1 a\nb", 9.0, 50.0)


def mirrored_vectors():
    """Vectors of 64 numbers whose gray levels mirror each other around 128, so that several levels part them equally well; some of a single level, and a null."""
    rng = np.random.default_rng(21)
    side = rng.integers(1, 127, (192, 32)) * (rng.random((192, 32)) < 0.5)
    levels = np.concatenate([side, -side], 1)
    # pictures of three levels, whose crops often have equally many of the outer two
    pictures = rng.integers(-1, 2, (640, 64)) * np.repeat(rng.integers(3, 127, 20), 32)[:, None]
    return [*(np.concatenate([levels, pictures]) / 512).tolist(), [0.0] * 64, [0.25] * 64, None]


@pytest.mark.parametrize("name", ["frame_thresholds", "frame_variants", "color_frames", "image_regions"])
def test_levels_that_part_equally_well_are_taken_as_in_the_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    from fiatscan.jobs import registry

    rows = [(k, k % 7, v) for k, v in enumerate(mirrored_vectors())]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = registry.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall()) and got


def test_the_first_of_equal_levels_is_taken():
    rng = np.random.default_rng(22)
    for _ in range(300):
        side = rng.integers(1, 127, rng.integers(2, 20))
        gray = np.concatenate([128 - side, 128 + side])
        counts = frames.counts_of(gray)
        apart = {}
        for level in np.unique(gray)[:-1].tolist():
            low, high = gray[gray <= level], gray[gray > level]
            apart[level] = Fraction(int(low.sum()) * len(high) - int(high.sum()) * len(low)) ** 2 / (len(low) * len(high))
        assert frames._best_level(counts) == min(k for k, v in apart.items() if v == max(apart.values()))


def test_code_of_candidates_is_compiled(spark):
    """The JVM never compiles a method of more than 8000 bytes, it interprets it for every row."""
    rows = spark.createDataFrame([(1, 0, 0, 0, "€12", 80, 80, 10, 5, 30, 20)], "image_id long, crop_idx int, variant_idx int, frag_idx int, text string, confidence int, digit_confidence int, x int, y int, width int, height int")
    held_before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = fragments.candidates(rows, F.lit("USD"))._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held_before)
    assert sizes and max(sizes) < 8000


def test_patterns_are_left_out_only_where_they_cannot_match():
    rng = random.Random(23)
    atoms = [*"0123456789" * 3, *".,- $€£" * 2, "EUR", "usd", "CHF", "Fr.", "a", "_", "\n", "05", "12 50", ",-"]
    found = lambda pattern, text: re.search(pattern, text, re.ASCII)
    letters = [text_price.BY_FRANC, text_price.BY_CODE_AFTER, text_price.BY_CODE_BEFORE]
    notations = [text_price.BY_SYMBOL, *letters, text_price.BARE_DECIMAL, text_price.SPACED_CENTS]
    for _ in range(20_000):
        text = "".join(rng.choice(atoms) for _ in range(rng.randrange(8)))
        for marks, repairs in text_price.REPAIRED_IF:
            assert found(marks, text) or not any(found(p, text) for p, _ in repairs)
        assert found("[A-Za-z]", text) or not any(found(p, text) for p in letters)
        if not (found("[0-9]", text) and found("[^0-9]", text)):
            assert not any(found(p, text) for p in [*notations, *(p for p, _ in text_price.REPAIRS)])
