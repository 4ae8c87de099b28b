"""Files as rows: listings, split plans, batches that can be addressed, discovery of what is there, vector and shape files."""

from __future__ import annotations

import html
import io
import json
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import numbered


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modified) of the files below a path whose names fit a glob pattern; their content is not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def split_plan(files: DataFrame, size: int) -> DataFrame:
    """(path, start, stop): every file of files(path, length) in pieces of at most `size` bytes; an empty file has none.

    Readers of such pieces read the lines that start in them, as Spark's own splits do (spark.sql.files.maxPartitionBytes)."""
    n = F.ceil(F.col("length") / size).cast("long")
    at = files.where("length > 0").select("path", "length", F.explode_outer(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    return at.select("path", (F.col("k") * size).alias("start"), F.least((F.col("k") + 1) * size, F.col("length")).alias("stop"))


def rechunk(df: DataFrame, path: str, rows: int, order: Sequence) -> None:
    """Write df in batches of `rows` rows in an order, batch n in the folder batch=n; written again, the batches are the same."""
    places = numbered(df, order, "__place")
    batch = F.floor((F.col("__place") - 1) / rows).cast("long").alias("batch")
    dealt = places.select(*df.columns, batch).repartition("batch").sortWithinPartitions("batch", *order)
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("batch").parquet(path)


def read_batch(spark: SparkSession, path: str, n: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Batch n of a rechunked table; no other folder is read."""
    own = spark.read.parquet(path).where(F.col("batch") == n).drop("batch")
    return own.select(*columns) if columns else own


def complete(files: DataFrame, suffixes: Sequence[str], most: int | None = None) -> DataFrame:
    """(stem): names without suffix of which files(path, ...) has all suffixes, in order, the first `most` if given."""
    name = F.substring_index("path", "/", -1)
    pieces = [F.when(name.endswith(s), F.struct(F.substr(name, F.lit(1), F.length(name) - len(s)).alias("stem"), F.lit(s).alias("suffix"))) for s in suffixes]
    own = files.select(F.coalesce(*pieces).alias("p")).where("p is not null").select("p.stem", "p.suffix").distinct()
    found = own.groupBy("stem").agg(F.count("*").alias("n")).where(F.col("n") == len(suffixes)).select("stem").orderBy("stem")
    return found.limit(most) if most is not None else found


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of pairs NAME.npy (a row a vector) and NAME.json (a list of their ids); a pair of unequal lengths raises."""

    def rows(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for stem, vectors, ids in zip(page["stem"], page["vectors"], page["ids"], strict=True):
                table, names = np.load(io.BytesIO(vectors), allow_pickle=False), json.loads(ids)
                if len(table) != len(names):
                    raise ValueError(f"{stem}: {len(table)} vectors and {len(names)} ids")
                yield pd.DataFrame({"id": [str(x) for x in names], "vector": list(table.astype(np.float32))})

    load = lambda kind: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path)
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem")
    both = load("npy").select(stem, F.col("content").alias("vectors")).join(load("json").select(stem, F.col("content").alias("ids")), "stem")
    return both.mapInPandas(rows, "id string, vector array<float>")


def shape_rings(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """The rings of each polygon record of a shapefile's main file; null shapes have none."""
    out, at = [], 100
    while at + 8 <= len(data):
        size = 2 * struct.unpack_from(">i", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        at += 8 + size
        if len(body) < 44 or struct.unpack_from("<i", body)[0] not in (5, 15, 25):
            out.append([])
            continue
        parts, points = struct.unpack_from("<2i", body, 36)
        cuts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
        flat = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
        xy = list(zip(flat[::2], flat[1::2], strict=True))
        out.append([xy[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    return out


def svg_path(rings: list[list[tuple[float, float]]], box: tuple[float, float, float, float], width: float) -> str:
    """An SVG path of rings, the box (x0, y0, x1, y1) being `width` wide and y pointing up."""
    x0, y0, x1, y1 = box
    k = width / (x1 - x0)
    return " ".join("M" + " L".join(f"{(x - x0) * k:.1f},{(y1 - y) * k:.1f}" for x, y in ring) + " Z" for ring in rings)


def choropleth(shapes: dict[str, str], values: dict[str, float], width: int, height: int, colours: Sequence[str] = ("#eee", "#9cf", "#39c", "#036")) -> str:
    """An SVG map: shapes by name as paths, coloured by their value's place between the least and the largest; without one, none."""
    low, high = min(values.values(), default=0), max(values.values(), default=0)
    step = lambda v: colours[min(len(colours) - 1, int(len(colours) * (v - low) / (high - low or 1)))]
    body = "".join(f'<path id="{name}" d="{path}" fill="{step(values[name]) if name in values else "none"}"/>' for name, path in sorted(shapes.items()))
    return f'<svg viewBox="0 0 {width} {height}">{body}</svg>'


def cards(rows: Sequence[dict], title: str, fields: Sequence[str], image: str | None = None) -> str:
    """HTML cards, one a row: an image if there is one, a title, and the fields that aren't null; everything is escaped."""
    out = []
    for row in rows:
        picture = f'<img src="{html.escape(str(row[image]))}">' if image and row.get(image) else ""
        lines = "".join(f"<li>{html.escape(name)}: {html.escape(str(row[name]))}</li>" for name in fields if row.get(name) is not None)
        out.append(f'<div class="card">{picture}<h3>{html.escape(str(row[title]))}</h3><ul>{lines}</ul></div>')
    return "".join(out)
