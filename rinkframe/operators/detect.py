"""A hook for stone detectors over images, and a detector of its own: coloured blobs with their boxes.

A detector is made once in each Python worker from a file of weights that the driver has shipped (SparkFiles), and is then asked picture by picture; it
returns as many boxes as it finds. Boxes go on to suppress() and to the coordinates of the sheet.

The own detector takes the pixels of a colour, labels connected components and fits a box to each. Components are found by runs: a row's
runs of marked pixels are joined with those of the row above that they touch, corners included, by union-find, so the work is one of runs and
not of pixels. A component is a stone if its size and form are those of a disc: its area over its box's must be near pi / 4. Of two stones that touch it finds one blob, which that test drops.

Defined results: null and undecodable images have no boxes, and so has a picture without the colour; of `keep` columns none may have the name of a result (an error); an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkframe.functions.geometry import sheet_coordinates
from rinkframe.operators import raster
from rinkframe.operators.pixels import suppress
from rinkframe.session import ship, table

BOXES = "cls int, conf double, x1 double, y1 double, x2 double, y2 double"
#: The own detector's weights: for each class the least and largest red, green and blue; a blob's least and largest side in pixels, and what share of its box it fills.
DEFAULT = {"colours": [[[120, 0, 0], [255, 110, 110]], [[150, 120, 0], [255, 255, 120]]], "side": [6, 40], "fill": [0.6, 0.95], "aspect": 1.5}


class Detector(Protocol):
    def __call__(self, picture: np.ndarray) -> list[tuple[int, float, float, float, float, float]]:
        """(class, confidence, x1, y1, x2, y2) of each box in a picture of height x width x 3."""


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(area, x1, y1, x2, y2), ends exclusive, of the connected components of a mask, by their first pixel."""
    h, w = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    root = list(range(len(row)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for r in range(1, h):
        a, b = first[r - 1], first[r]
        while a < first[r] and b < first[r + 1]:  # runs of two rows, from the left
            if start[a] <= end[b] and start[b] <= end[a]:
                x, y = find(int(a)), find(int(b))
                root[max(x, y)] = min(x, y)
            if end[a] < end[b]:
                a += 1
            else:
                b += 1
    of: dict[int, list[int]] = {}
    for i in range(len(row)):
        of.setdefault(find(i), []).append(i)
    return [(int((end[i] - start[i]).sum()), int(start[i].min()), int(row[i[0]]), int(end[i].max()), int(row[i[-1]]) + 1) for i in of.values()]


class Blobs:
    """The own detector."""

    def __init__(self, weights: str | None):
        self.of = DEFAULT if weights is None else json.load(open(weights))

    def __call__(self, picture: np.ndarray) -> list[tuple[int, float, float, float, float, float]]:
        out, (least, most), (thin, full) = [], self.of["side"], self.of["fill"]
        for cls, (low, high) in enumerate(self.of["colours"]):
            for area, x1, y1, x2, y2 in components(((picture >= low) & (picture <= high)).all(2)):
                w, h = x2 - x1, y2 - y1
                fill = area / (w * h)
                if least <= min(w, h) and max(w, h) <= most and thin <= fill <= full and max(w, h) <= self.of["aspect"] * min(w, h):
                    out.append((cls, max(0.0, 1 - abs(fill - np.pi / 4)), float(x1), float(y1), float(x2), float(y2)))
        return out


#: Detectors of this worker, by what makes them and their weights.
_LOADED: dict[tuple, Detector] = {}


def loaded(make: Callable[[str | None], Detector], weights: str | None) -> Detector:
    """The detector of this worker, made when it is first asked for."""
    key = (make.__module__, make.__qualname__, weights)
    if key not in _LOADED:
        _LOADED[key] = make(None if weights is None else SparkFiles.get(weights))
    return _LOADED[key]


def detect(images: DataFrame, column: str = "content", keep: tuple[str, ...] = ("image_name",), make: Callable[[str | None], Detector] = Blobs, weights: str | None = None, prepare: tuple[Callable[[np.ndarray], np.ndarray], ...] = ()) -> DataFrame:
    """Keep columns and the boxes (see BOXES) of each image file. weights: a file on the driver, which all workers get. prepare: see raster.decode."""
    spark = images.sparkSession
    ship(spark)
    if weights is not None:
        spark.sparkContext.addFile(weights)
        weights = os.path.basename(weights)
    rows = images.select(*keep, F.col(column).alias("__file"))
    names = [x.split()[0] for x in BOXES.split(", ")]
    if clash := set(keep) & set(names):
        raise ValueError(f"columns named like results: {sorted(clash)}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = loaded(make, weights)
        for batch in batches:
            found, at = [], []
            for i in range(batch.num_rows):
                x = raster.decoded(batch.column("__file")[i].as_py())
                for f in prepare if x is not None else ():
                    x = f(x)
                boxes = [] if x is None else detector(x)
                found += boxes
                at += [i] * len(boxes)
            own = batch.select(list(keep)).take(pa.array(at, pa.int64()))
            kinds = [pa.int32(), *[pa.float64()] * 5]
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([b[k] for b in found], t) for k, t in enumerate(kinds))], [*keep, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__file"), BOXES])
    return rows.mapInArrow(run, schema)


def stones(images: DataFrame, image: str = "image_name", **options) -> DataFrame:
    """Image, cls, x, y, distance_from_center, inhouse of the stones of each image of a sheet, of overlapping boxes the surest."""
    boxes = suppress(detect(images, keep=(image,), **options), image)
    x, y, distance, house = sheet_coordinates((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)
    return boxes.select(image, "cls", x.alias("x"), y.alias("y"), distance.alias("distance_from_center"), house.alias("inhouse"))


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as a picture of 96 x 64 with up to six discs of 9 pixels in places of their own; the colour and the place in a cell of 30 x 30 come from its numbers."""
    ship(spark)
    rows = table(spark, d, "embeddings").where("embedding is not null and size(embedding) >= 18").select("vec_id", F.slice("embedding", 1, 18).alias("x"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, xs = np.mgrid[-4:5, -4:5]
        disc = xs * xs + ys * ys <= 18
        for batch in batches:
            made = []
            for x in batch.column("x").to_pylist():
                picture = np.full((64, 96, 3), 230, np.uint8)
                for k in range(6):
                    v, dx, dy = x[3 * k : 3 * k + 3]
                    if v > -0.1:
                        px, py = k % 3 * 30 + 8 + int(abs(dx) * 1000) % 16, k // 3 * 30 + 8 + int(abs(dy) * 1000) % 16
                        picture[py - 4 : py + 5, px - 4 : px + 5][disc] = (200, 30, 30) if v > 0.05 else (230, 200, 40)
                made.append(raster.png(picture, np.full(64, 2)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(made, pa.binary())], ["vec_id", "content"])

    return rows.mapInArrow(run, "vec_id bigint, content binary")


def q_detected_stones(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of the discs in each vector's picture."""
    return detect(_sheets(spark, d), keep=("vec_id",)).select("vec_id", "cls", "x1", "y1", "x2", "y2")


QUERIES = {"detected_stones": q_detected_stones}
ORACLE_SQL = {
    "detected_stones": """WITH k AS (SELECT vec_id, k, CAST(embedding[3 * k + 1] AS DOUBLE) AS v, CAST(floor(abs(CAST(embedding[3 * k + 2] AS DOUBLE)) * 1000) AS BIGINT) % 16 AS dx, CAST(floor(abs(CAST(embedding[3 * k + 3] AS DOUBLE)) * 1000) AS BIGINT) % 16 AS dy FROM embeddings, generate_series(0, 5) g(k) WHERE len(embedding) >= 18)
SELECT vec_id, CASE WHEN v > CAST(0.05 AS DOUBLE) THEN 0 ELSE 1 END AS cls, CAST(k % 3 * 30 + 4 + dx AS DOUBLE) AS x1, CAST(k // 3 * 30 + 4 + dy AS DOUBLE) AS y1, CAST(k % 3 * 30 + 13 + dx AS DOUBLE) AS x2, CAST(k // 3 * 30 + 13 + dy AS DOUBLE) AS y2 FROM k WHERE v > CAST(-0.1 AS DOUBLE)""",
}
