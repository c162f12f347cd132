"""Frames: quality gate, threshold, variants, crop rectangles and regions.

A frame has frame_id, session_id, seq, width, height and gray, an array of levels row by row. Work on pixels that
a join would only blow up (scores, components) runs in numpy, a frame at a time; the rest is columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from fiatscan.functions.geometry import half_up
from fiatscan.schemas import MAX_MOTION, MIN_CONTRAST, MIN_REGION_AREA, MIN_SHARPNESS

from .runs import measured, painted, runs_of
from .tiles import foreground, tiled_regions

ASPECT = 16 / 9
TILE = 1024
# The target box of a preview, and the variants that are read.
BOX_WIDTH, BOX_HEIGHT, OFFSETS = 0.75, 0.35, (0.0, 0.22, 0.44)
FOCUS_WIDTH, FOCUS_HEIGHT = 300, 100
DRAWN_SCALE = 2
FOCUS = ((0.5, 0.42, 0.45, 0.45), (0.42, 0.0, 0.53, 1.0))
MODES = (("grayscale", None), ("threshold", "128"), ("threshold", "160"), ("threshold", "auto"), ("threshold-invert", "auto"))


def sharpness(gray: np.ndarray, width: int, height: int) -> float:
    """Mean square of the four-neighbour Laplacian on inner pixels; 0 below three pixels a side."""
    if width < 3 or height < 3 or len(gray) != width * height:
        return 0.0
    g = gray.reshape(height, width).astype(np.int64)
    laplacian = g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1]
    return float((laplacian * laplacian).sum() / laplacian.size)


def _sharp(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.drop(columns=["width", "height"]).assign(sharpness=[sharpness(np.asarray(g), w, h) for g, w, h in zip(pdf["gray"], pdf["width"], pdf["height"])])


def with_sharpness(frames: DataFrame) -> DataFrame:
    """frame_id, session_id, seq, gray, sharpness: one pass, and pixels go on with their score."""
    rows = frames.select("frame_id", "session_id", "seq", "gray", "width", "height")
    schema = StructType([*(f for f in rows.schema.fields if f.name not in ("width", "height")), StructField("sharpness", DoubleType())])
    return rows.mapInPandas(_sharp, schema)


def contrast(gray: Column) -> Column:
    """Standard deviation of the levels of a frame; 0 for none."""
    total = lambda f: F.aggregate(gray, F.lit(0).cast("long"), lambda s, v: s + f(v).cast("long"))
    n = F.size(gray)
    mean = total(lambda v: v) / n
    spread = F.aggregate(gray, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
    return F.when(n > 0, F.sqrt(spread / n)).otherwise(0.0)


def motion(previous: Column, gray: Column) -> Column:
    """Mean absolute change of levels; 0 without a previous frame of the same size."""
    change = F.aggregate(F.zip_with(previous, gray, lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, v: s + v.cast("long"))
    return F.when(previous.isNotNull() & (F.size(previous) == F.size(gray)) & (F.size(gray) > 0), change / F.size(gray)).otherwise(0.0)


def reason(sharp: Column, contrasted: Column, moved: Column) -> Column:
    """Why a frame is rejected; null if it is not."""
    return F.when(sharp < MIN_SHARPNESS, "blur").when(contrasted < MIN_CONTRAST, "low-contrast").when(moved > MAX_MOTION, "motion")


def quality(frames: DataFrame) -> DataFrame:
    """frame_id, sharpness, contrast, motion, reason; motion is against the session's frame before, accepted or not."""
    scores = with_sharpness(frames)
    before = F.lag("gray").over(Window.partitionBy("session_id").orderBy("seq"))
    out = scores.select("frame_id", "sharpness", contrast(F.col("gray")).alias("contrast"), motion(before, F.col("gray")).alias("motion"))
    return out.withColumn("reason", reason(F.col("sharpness"), F.col("contrast"), F.col("motion")))


LEVELS = 256


def counts_of(gray: np.ndarray) -> np.ndarray:
    return np.bincount(gray, minlength=LEVELS)[:LEVELS]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        levels = batch.column("gray")
        frame = pc.list_parent_indices(levels).to_numpy()
        flat = levels.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.bincount(frame * LEVELS + flat, minlength=batch.num_rows * LEVELS)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * LEVELS, pa.int32()), pa.array(n))
        yield pa.RecordBatch.from_arrays([batch.column("frame_id"), rows], ["frame_id", "counts"])


def histogram(frames: DataFrame) -> DataFrame:
    """frame_id, counts: how many pixels of a frame have each of the levels 0 to 255, without a shuffle."""
    rows = frames.select("frame_id", F.coalesce("gray", F.array().cast("array<int>")).alias("gray"))
    return rows.mapInArrow(_counted, StructType([rows.schema["frame_id"], StructField("counts", ArrayType(LongType()))]))


def best_levels(counts: np.ndarray) -> np.ndarray:
    """For each row of counts, the first level with the greatest variance between the classes; 128 if no level parts the counts.

    Variances that are equal to six decimals tie: levels that mirror each other have equal ones, but for the noise of their last bits. A level that the row lacks
    parts it as the one below does, so only levels present count.
    """
    w, s = np.cumsum(counts, axis=1), np.cumsum(counts * np.arange(LEVELS), axis=1)
    above = w[:, -1:] - w
    inner = (counts > 0) & (above > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = s / w - (s[:, -1:] - s) / above
    scaled = np.where(inner, w.astype(float) * above * (apart * apart) * 1e6, -1.0)
    whole = np.floor(scaled)
    variance = (whole + (scaled - whole >= 0.5)) / 1e6
    return np.where(inner.any(axis=1), variance.argmax(axis=1), 128)


CHUNK = 1024


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            counts = part.column("counts").flatten().to_numpy().reshape(-1, LEVELS)
            yield pa.RecordBatch.from_arrays([part.column("frame_id"), pa.array(best_levels(counts), pa.int32())], ["frame_id", "threshold"])


def otsu(levels: DataFrame) -> DataFrame:
    """frame_id, threshold: the level that parts each frame's counts best."""
    rows = levels.select("frame_id", "counts")
    return rows.mapInArrow(_parted, StructType([rows.schema["frame_id"], StructField("threshold", IntegerType())]))


def variant_label(index: Column) -> Column:
    """mode[:threshold] of a variant; unknown-n beyond the list."""
    names = F.array(*[F.lit(m if t is None else f"{m}:{t}") for m, t in MODES])
    return F.coalesce(F.get(names, index), F.concat(F.lit("unknown-"), index.cast("string")))


def variants(frames: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Each frame in each mode: frame_id, variant_idx, label, gray."""
    out = frames.join(thresholds, "frame_id").select("frame_id", "gray", "threshold", F.explode(F.array(*map(F.lit, range(len(MODES))))).alias("variant_idx"))
    at = F.when(F.col("variant_idx") == 1, 128).when(F.col("variant_idx") == 2, 160).otherwise(F.col("threshold"))
    cut = F.transform("gray", lambda v: F.when((v >= at) == (F.col("variant_idx") < 4), 255).otherwise(0))
    return out.select("frame_id", "variant_idx", variant_label(F.col("variant_idx")).alias("label"), F.when(F.col("variant_idx") == 0, F.col("gray")).otherwise(cut).alias("gray"))


def to_gray(r: Column, g: Column, b: Column) -> Column:
    return half_up(0.299 * r + 0.587 * g + 0.114 * b)


def with_gray(pictures: DataFrame) -> DataFrame:
    """pictures (red, green, blue: arrays of levels row by row, ...) with `gray` instead of the three."""
    gray = F.transform(F.arrays_zip("red", "green", "blue"), lambda p: to_gray(p["red"], p["green"], p["blue"]).cast("int"))
    return pictures.withColumn("gray", gray).drop("red", "green", "blue")


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, which later ones read instead of repeating (Spark merges plain projections into one expression, which here grows past what compiles)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _focus(w: Column, h: Column) -> Column:
    """The two smaller boxes of a crop of this size."""
    out = []
    for k, (fx, fy, fw, fh) in enumerate(FOCUS):
        bw, bh = half_up(w * fw), half_up(h * fh)
        out.append(F.struct(F.lit(k).alias("focus_idx"), F.least(w - bw, F.greatest(F.lit(0), half_up(w * fx))).alias("fx"), F.least(h - bh, F.greatest(F.lit(0), half_up(h * fy))).alias("fy"), F.greatest(F.lit(1), bw).alias("fw"), F.greatest(F.lit(1), bh).alias("fh")))
    return F.array(*out)


def with_boxes(images: DataFrame, focus_size: tuple[int, int] = (FOCUS_WIDTH, FOCUS_HEIGHT)) -> DataFrame:
    """images (width, height, ...) with `boxes`: the target box at three heights of the part that a preview shows, and `focus`: two smaller boxes
    inside each of them, in its coordinates, if it is at least `focus_size`."""
    w, h = F.col("width"), F.col("height")
    wide = w / h > ASPECT
    out = _held(images, vw=F.when(wide, half_up(h * ASPECT)).otherwise(w), vh=F.when(wide, h).otherwise(half_up(w / ASPECT)))
    vw, vh = F.col("vw"), F.col("vh")
    out = _held(out, vx=F.when(wide, half_up((w - vw) / 2)).otherwise(0), vy=F.when(wide, 0).otherwise(half_up((h - vh) / 2)), cw=half_up(vw * BOX_WIDTH), ch=half_up(vh * BOX_HEIGHT))
    vx, vy, cw, ch = (F.col(c) for c in ("vx", "vy", "cw", "ch"))
    at = lambda o: F.greatest(vy, F.least(vy + vh - ch, vy + half_up((vh - ch) / 2) + half_up(vh * o)))
    boxes = F.array(*[F.struct(F.lit(k).alias("crop_idx"), (vx + half_up((vw - cw) / 2)).alias("x"), at(o).alias("y"), cw.alias("width"), ch.alias("height")) for k, o in enumerate(OFFSETS)])
    focus = F.when((cw >= focus_size[0]) & (ch >= focus_size[1]), _focus(cw, ch))
    return _held(out, boxes=boxes, focus=focus).drop("vw", "vh", "vx", "vy", "cw", "ch")


def crops(images: DataFrame) -> DataFrame:
    """images (image_id, width, height) -> image_id, crop_idx, x, y, width, height: the three target boxes of an image."""
    return with_boxes(images.select("image_id", "width", "height")).select("image_id", F.inline("boxes"))


def focused(rects: DataFrame) -> DataFrame:
    """Two smaller boxes inside crops of at least 300 x 100, in the crop's coordinates."""
    w, h = F.col("width"), F.col("height")
    large = rects.where((w >= FOCUS_WIDTH) & (h >= FOCUS_HEIGHT))
    return large.select("image_id", "crop_idx", F.inline(_focus(w, h)))


def polarity(frames: DataFrame, threshold: int = 128) -> DataFrame:
    """frame_id, dark, light, foreground: the class with fewer pixels, dark of equals; a frame of one class is that class."""
    dark = F.size(F.filter("gray", lambda v: v < threshold))
    out = frames.select("frame_id", dark.alias("dark"), (F.size("gray") - dark).alias("light"))
    return out.withColumn("foreground", F.when(F.col("dark") == 0, "light").when(F.col("light") == 0, "dark").when(F.col("dark") <= F.col("light"), "dark").otherwise("light"))


def component_labels(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 4-connected parts of a mask, in raster order of their first pixels; 0 outside."""
    return painted(runs_of(mask), mask.shape)


def mask_regions(mask: np.ndarray, least: int, scale: int = 1) -> dict[str, np.ndarray]:
    """Regions of a mask whose pixels are drawn `scale` times as wide and high, of at least `least` drawn pixels, in raster order."""
    m = measured(runs_of(mask))
    kept = m["area"] * scale * scale >= least
    m = {k: v[kept] for k, v in m.items()}
    centre = lambda total: scale * total / m["area"] + (scale - 1) / 2
    return {
        "region_idx": np.arange(len(m["area"])), "x": m["min_x"] * scale, "y": m["min_y"] * scale, "width": (m["max_x"] - m["min_x"] + 1) * scale, "height": (m["max_y"] - m["min_y"] + 1) * scale,
        "center_x": centre(m["sum_x"]), "center_y": centre(m["sum_y"]), "area": m["area"] * scale * scale,
    }


_REGION = "region_idx int, x int, y int, width int, height int, center_x double, center_y double, area int"
_TYPES = {"center_x": pa.float64(), "center_y": pa.float64()}


def _batch(given: dict[str, object], found: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Regions with what holds for all of them."""
    n = len(found["area"])
    fixed = {k: pa.array([v] * n, pa.string() if isinstance(v, str) else pa.int64() if k.endswith("_id") else pa.int32()) for k, v in given.items()}
    return pa.RecordBatch.from_arrays([*fixed.values(), *(pa.array(v).cast(_TYPES.get(k, pa.int32())) for k, v in found.items())], [*fixed, *found])


def _whole_regions(least: int, threshold: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                frame, width, height = (batch.column(c)[k].as_py() for c in ("frame_id", "width", "height"))
                gray = batch.column("gray")[k].values
                if gray is not None and len(gray) == width * height and len(gray):
                    mask = foreground(gray.to_numpy(zero_copy_only=False), threshold).reshape(height, width)
                    out.append(_batch({"frame_id": frame}, mask_regions(mask, least)))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return made


def regions(frames: DataFrame, least: int = MIN_REGION_AREA, threshold: int = 128, tile: int = TILE) -> DataFrame:
    """Connected regions of each frame's foreground, at least `least` pixels, in raster order.

    Parts are joined along rows and columns only; a region does not wrap from one row's end to the next row's start. Frames of more than tile x tile
    pixels are cut into tiles, which tasks label apart.
    """
    size = F.col("width").cast("long") * F.col("height")
    rows = frames.select("frame_id", "width", "height", "gray").where(F.col("gray").isNotNull())
    small = rows.where(size <= tile * tile).mapInArrow(_whole_regions(least, threshold), f"frame_id long, {_REGION}")
    large = rows.where(size > tile * tile)
    if not large.limit(1).count():
        return small
    return small.unionByName(tiled_regions(large, least, threshold, tile))


def _best_level(counts: np.ndarray) -> int:
    """As `otsu`, for pixels that never become rows."""
    return int(best_levels(counts[None])[0])


def dark_masks(gray: np.ndarray) -> list[np.ndarray]:
    """For each of MODES, the pixels of a picture that are dark (below 128) after it."""
    auto = _best_level(counts_of(gray.ravel()))
    at = {None: 128, "128": 128, "160": 160, "auto": auto}
    return [gray >= at[t] if m == "threshold-invert" else gray < at[t] for m, t in MODES]


def _picture_regions(least: int, scale: int):
    def variants_of(gray: np.ndarray, box: dict, focus: list[dict] | None) -> Iterator[np.ndarray]:
        """The crop, then its smaller boxes: views of the picture's pixels."""
        crop = gray[box["y"] : box["y"] + box["height"], box["x"] : box["x"] + box["width"]]
        yield crop
        for f in focus or ():
            yield crop[f["fy"] : f["fy"] + f["fh"], f["fx"] : f["fx"] + f["fw"]]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image, width, height, boxes, focus = (batch.column(c)[k].as_py() for c in ("image_id", "width", "height", "boxes", "focus"))
                gray = batch.column("gray")[k].values.to_numpy(zero_copy_only=False)
                if len(gray) != width * height:
                    continue
                gray, out = gray.reshape(height, width), []
                for box in boxes:
                    views = (v for v in variants_of(gray, box, focus) if v.size)
                    for number, (view, dark) in enumerate((view, dark) for view in views for dark in dark_masks(view)):
                        n = int(np.count_nonzero(dark))
                        mask = dark if n and (n == dark.size or n <= dark.size - n) else ~dark
                        given = {"image_id": image, "crop_idx": box["crop_idx"], "variant_idx": number, "variant_width": view.shape[1] * scale, "variant_height": view.shape[0] * scale}
                        out.append(_batch(given, mask_regions(mask, least, scale)))
                if out:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return made


def picture_regions(pictures: DataFrame, least: int = MIN_REGION_AREA, scale: int = DRAWN_SCALE, focus_size: tuple[int, int] = (FOCUS_WIDTH, FOCUS_HEIGHT)) -> DataFrame:
    """pictures (image_id, width, height, gray) -> the regions of every variant of every crop, in one pass over the pixels.

    A picture has three crops, a large crop two smaller boxes, each of these five modes: 5 or 15 variants a crop, drawn `scale` times as large. None of them is stored or
    leaves the task; what leaves are regions, in the variant's coordinates, with the variant's own size.
    """
    rows = with_boxes(pictures.select("image_id", "width", "height", "gray").where(F.col("gray").isNotNull()), focus_size)
    found = rows.mapInArrow(_picture_regions(least, scale), f"image_id long, crop_idx int, variant_idx int, variant_width int, variant_height int, {_REGION}")
    return found.withColumn("label", variant_label(F.col("variant_idx")))


def not_whole(found: DataFrame, image_area: Column) -> DataFrame:
    """Regions below 85 % of the image."""
    return found.where(F.col("area") < image_area * 0.85)
