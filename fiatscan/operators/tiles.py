"""Regions of frames that are cut into tiles: parts are labelled in each tile apart, joined across the seams, and their measures added.

A part is named by the frame's place of its first pixel, so the least name among joined parts is the region's first pixel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiatscan.sources.tables import written

from .runs import MEASURES, firsts, measured, painted, runs_of, united

TILES = "frame_id long, across int, x0 int, y0 int, width int, height int, mask binary"
_PART = "node: bigint, " + ", ".join(f"{m}: bigint" for m in MEASURES)
_SEAM = "upright: boolean, at: int, place: int, node: bigint"


def foreground(gray: np.ndarray, threshold: int) -> np.ndarray:
    """The class with fewer pixels, dark of equals; a frame of one class is that class."""
    dark = gray < threshold
    n = int(np.count_nonzero(dark))
    return dark if n and (n == dark.size or n <= dark.size - n) else ~dark


def _cut(tile: int, threshold: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                frame, width, height = (batch.column(c)[k].as_py() for c in ("frame_id", "width", "height"))
                gray = batch.column("gray")[k].values.to_numpy(zero_copy_only=False)
                if len(gray) != width * height:
                    continue
                mask = foreground(gray, threshold).reshape(height, width)
                for y in range(0, height, tile):
                    for x in range(0, width, tile):
                        part = mask[y : y + tile, x : x + tile]
                        yield pa.RecordBatch.from_pylist([{"frame_id": frame, "across": width, "x0": x, "y0": y, "width": part.shape[1], "height": part.shape[0], "mask": np.packbits(part).tobytes()}], _schema())

    return made


def _schema() -> pa.Schema:
    return pa.schema([("frame_id", pa.int64()), *((c, pa.int32()) for c in ("across", "x0", "y0", "width", "height")), ("mask", pa.binary())])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles -> frame_id, parts (measures in the frame's coordinates), seams (the parts at the tile's edges, pixel by pixel)."""
    part_type = pa.list_(pa.struct([("node", pa.int64()), *((m, pa.int64()) for m in MEASURES)]))
    seam_type = pa.list_(pa.struct([("upright", pa.bool_()), ("at", pa.int32()), ("place", pa.int32()), ("node", pa.int64())]))
    for batch in batches:
        for t in batch.to_pylist():
            n = t["width"] * t["height"]
            mask = np.unpackbits(np.frombuffer(t["mask"], np.uint8), count=n).astype(bool).reshape(t["height"], t["width"])
            runs = runs_of(mask)
            runs.row, runs.start, runs.end = runs.row + t["y0"], runs.start + t["x0"], runs.end + t["x0"]
            first = firsts(runs)
            node = runs.row[first] * t["across"] + runs.start[first]
            found = {"node": node, **measured(runs)}
            runs.row, runs.start, runs.end = runs.row - t["y0"], runs.start - t["x0"], runs.end - t["x0"]
            label = painted(runs, mask.shape)
            seams = []
            for upright, at, line, low in ((True, t["x0"], label[:, 0], t["y0"]), (True, t["x0"] + t["width"], label[:, -1], t["y0"]), (False, t["y0"], label[0], t["x0"]), (False, t["y0"] + t["height"], label[-1], t["x0"])):
                for place in np.flatnonzero(line).tolist():
                    seams.append({"upright": upright, "at": at, "place": low + place, "node": int(node[line[place] - 1])})
            rows = [dict(zip(found, v)) for v in zip(*(c.tolist() for c in found.values()))]
            yield pa.RecordBatch.from_arrays([pa.array([t["frame_id"]]), pa.array([rows], part_type), pa.array([seams], seam_type)], ["frame_id", "parts", "seams"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """frame_id, links -> frame_id, node, region: for every part that a link names."""
    for batch in batches:
        for k in range(batch.num_rows):
            links = batch.column("links")[k].values
            a, b = (links.field(c).to_numpy() for c in ("a", "b"))
            nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = nodes[united(len(nodes), place[: len(a)], place[len(a) :])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), batch.column("frame_id")[k].as_py())), pa.array(nodes), pa.array(root)], ["frame_id", "node", "region"])


def tiled_regions(frames: DataFrame, least: int, threshold: int, tile: int) -> DataFrame:
    """Regions of at least `least` pixels of each frame's foreground, in raster order of their first pixels; tiles of one frame are spread over tasks."""
    cut = frames.select("frame_id", "width", "height", "gray").mapInArrow(_cut(tile, threshold), TILES).repartition("frame_id", "x0", "y0")
    held = written(cut.mapInArrow(_parts, f"frame_id long, parts array<struct<{_PART}>>, seams array<struct<{_SEAM}>>"), "tiles")
    seams = held.select("frame_id", F.inline("seams")).groupBy("frame_id", "upright", "at", "place").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    links = seams.where("a <> b").select("frame_id", "a", "b").distinct().groupBy("frame_id").agg(F.collect_list(F.struct("a", "b")).alias("links"))
    names = links.mapInArrow(_joined, "frame_id long, node long, region long")
    parts = held.select("frame_id", F.inline("parts")).join(names, ["frame_id", "node"], "left").withColumn("region", F.coalesce("region", "node"))
    fold = [(F.sum if m.startswith("sum") or m == "area" else F.min if m.startswith("min") else F.max)(m).alias(m) for m in MEASURES]
    whole = parts.groupBy("frame_id", "region").agg(*fold).where(F.col("area") >= least)
    order = Window.partitionBy("frame_id").orderBy("region")
    return whole.select(
        "frame_id", (F.row_number().over(order) - 1).alias("region_idx"), F.col("min_x").cast("int").alias("x"), F.col("min_y").cast("int").alias("y"),
        (F.col("max_x") - F.col("min_x") + 1).cast("int").alias("width"), (F.col("max_y") - F.col("min_y") + 1).cast("int").alias("height"),
        (F.col("sum_x") / F.col("area")).alias("center_x"), (F.col("sum_y") / F.col("area")).alias("center_y"), F.col("area").cast("int").alias("area"),
    )
