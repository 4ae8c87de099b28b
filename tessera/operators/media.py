"""Images and rasters as numpy arrays: orientation, sizes, features, scoring against prompts, detections, band algebra.

A picture is the bytes of a .npy file (height x width x 3, 0 to 255), so no codec is needed; `decode` can be any other one.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def load(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def dump(picture: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, picture)
    return out.getvalue()


def upright(picture: np.ndarray, orientation: int | None) -> np.ndarray:
    """The picture as it is to be seen, by its EXIF orientation of 1 to 8 (anything else: as it is)."""
    turned = {2: lambda p: p[:, ::-1], 3: lambda p: p[::-1, ::-1], 4: lambda p: p[::-1], 5: lambda p: p.swapaxes(0, 1), 6: lambda p: np.rot90(p, -1), 7: lambda p: p[::-1, ::-1].swapaxes(0, 1), 8: lambda p: np.rot90(p)}
    return np.ascontiguousarray(turned.get(orientation, lambda p: p)(picture))


def _shares(n: int, out: int) -> np.ndarray:
    """out x n weights: the share that each of n equal cells has in each of `out` equal cells."""
    edges, step = np.arange(out + 1) * n / out, np.arange(n)
    low, high = np.maximum(edges[:-1, None], step), np.minimum(edges[1:, None], step + 1)
    return np.maximum(high - low, 0) * out / n


def resized(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over areas, which may cut pixels."""
    return np.einsum("ih,hwc,jw->ijc", _shares(picture.shape[0], height), picture.astype(np.float64), _shares(picture.shape[1], width))


def thumbnail(picture: np.ndarray, size: int) -> np.ndarray:
    """Within size x size, its shape kept; never larger than it was."""
    h, w = picture.shape[:2]
    k = min(1.0, size / max(h, w))
    return np.round(resized(picture, max(1, round(h * k)), max(1, round(w * k)))).astype(np.uint8)


def features(picture: np.ndarray, size: int = 128) -> tuple[float, float]:
    """Brightness (mean of 0 to 1) and edge density (mean absolute step between neighbours of the grey picture, along both axes)."""
    small = resized(picture, size, size) / 255
    grey = small.mean(2)
    return float(small.mean()), float((np.abs(np.diff(grey, axis=1)).mean() + np.abs(np.diff(grey, axis=0)).mean()) / 2)


def thumbnails(pictures: DataFrame, key: str, data: str, sizes: Sequence[int] = (256, 512, 1024), orientation: str | None = None, decode: Callable[[bytes], np.ndarray] = load, encode: Callable[[np.ndarray], bytes] = dump) -> DataFrame:
    """key, size, width, height, data, error: every picture at every size; one that can't be read is a row with its error."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for name, body, turn in zip(page["key"], page["data"], page["turn"], strict=True):
                try:
                    picture = upright(decode(body), None if turn is None or turn != turn else int(turn))
                    small = [(size, thumbnail(picture, size)) for size in sizes]
                    rows = [(name, size, p.shape[1], p.shape[0], encode(p), None) for size, p in small]
                except Exception as e:
                    rows = [(name, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["key", "size", "width", "height", "data", "error"]).astype(object)

    own = pictures.select(F.col(key).alias("key"), F.col(data).alias("data"), (F.col(orientation) if orientation else F.lit(None)).cast("int").alias("turn"))
    return own.mapInPandas(run, f"key {pictures.schema[key].dataType.simpleString()}, size int, width int, height int, data binary, error string").withColumnRenamed("key", key)


def with_features(pictures: DataFrame, data: str, decode: Callable[[bytes], np.ndarray] = load) -> DataFrame:
    """pictures and width, height, brightness, edge_density, error."""

    @F.pandas_udf("width int, height int, brightness double, edge_density double, error string")
    def of(bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for body in bodies:
            try:
                picture = decode(body)
                rows.append((picture.shape[1], picture.shape[0], *features(picture), None))
            except Exception as e:
                rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["width", "height", "brightness", "edge_density", "error"])

    return pictures.withColumn("__found", of(F.col(data))).select("*", "__found.*").drop("__found")


def prompt_scores(vector: Column, prompts: dict[str, Sequence[float]]) -> list[Column]:
    """A column a prompt: the cosine of an image vector with the prompt's, as an expression over the (few) prompts."""
    from .vectors import cosine

    return [cosine(vector, F.array(*[F.lit(float(x)) for x in own])).alias(name) for name, own in prompts.items()]


PETS = ("cat", "dog")


def detections(boxes: Column, height: Column, counted: Sequence[str] = ("person", "potted plant", "couch", "bed", "cat", "dog"), least: float = 0.25) -> Column:
    """struct of what is in array<struct<label,score,x0,y0,x1,y1>>: the number of each counted label, pets, objects in all, a
    television, and whether the best one's middle lies in the upper half."""
    sure = F.filter(boxes, lambda b: b["score"] >= least)
    name = lambda label: label.replace(" ", "_") + "_count"

    def of(*labels: str) -> Column:
        return F.filter(sure, lambda b: b["label"].isin(*labels))

    screens = F.array_sort(F.transform(of("tv"), lambda b: F.struct((-b["score"]).alias("s"), ((b["y0"] + b["y1"]) / 2).alias("middle"))))
    best = F.get(screens, F.lit(0))
    counts = [F.coalesce(F.size(of(label)), F.lit(0)).alias(name(label)) for label in counted]
    return F.struct(*counts, F.size(of(*PETS)).alias("pet_count"), F.size(sure).alias("n_objects"), (F.size(screens) > 0).alias("tv_detected"), F.coalesce(best["middle"] < height / 2, F.lit(False)).alias("tv_above_middle"))


def ndvi(tiles: DataFrame, key: str, red: str, infrared: str, decode: Callable[[bytes], np.ndarray] = load) -> DataFrame:
    """key, mean_ndvi, pixels, error: (infrared - red) / (infrared + red) over the pixels of two bands of equal shape."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            rows = []
            for name, a, b in zip(page["key"], page["red"], page["infrared"], strict=True):
                try:
                    low, high = decode(a).astype(np.float32), decode(b).astype(np.float32)
                    if low.shape != high.shape:
                        raise ValueError(f"bands of {low.shape} and {high.shape}")
                    index = (high - low) / (high + low + 1e-6)
                    rows.append((name, float(index.mean()), int(index.size), None))
                except Exception as e:
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "mean_ndvi", "pixels", "error"]).astype(object)

    own = tiles.select(F.col(key).alias("key"), F.col(red).alias("red"), F.col(infrared).alias("infrared"))
    return own.mapInPandas(run, f"key {tiles.schema[key].dataType.simpleString()}, mean_ndvi double, pixels long, error string").withColumnRenamed("key", key)
