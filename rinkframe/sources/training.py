"""The detector's data set as files, written by a data source whose tasks report what they wrote.

    <root>/<doc_id>/images/<split>/page7_2.png      the second image of page 7
    <root>/<doc_id>/labels/<split>/page7_2.txt      its label, a line for each box
    <root>/<doc_id>/dataset.yaml                    folders and classes

Tasks write under a folder of the run that nobody reads and return names; the driver gives the files their names when all tasks are done. So a task that fails or is
repeated leaves nothing, and an aborted run leaves the data set as it was. A book's data set is bounded by the budget, and so is what the driver renames.

Defined results: an image without a label (null) is left out with its file, one with an empty label has an empty file; images that can't be decoded are left out before they are counted;
of repeated names the last that is renamed stays; rows without a document, split, name or content are left out; no rows write no files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from pyarrow import fs

from rinkframe.operators import raster
from rinkframe.operators.labels import description
from rinkframe.operators.sequences import whole_pages_until
from rinkframe.plans.book import DETAIL
from rinkframe.session import ship, table
from rinkframe.sources.bundles import file_system, remove

NAME = "training_set"
#: Images of a book after which no further page is taken.
BUDGET = 400
PAGE = ["doc_id", "page_no"]


def harvest(pages: DataFrame, images: DataFrame, budget: int = BUDGET, detail: str = DETAIL) -> DataFrame:
    """Images (doc_id, page_no, xref, ...) of each book's first detail pages, whole pages until `budget` images are reached; with image_no (W8: by xref) and image_name."""
    shown = pages.where(F.col("text").contains(detail)).select(*PAGE)
    counted = shown.join(images.groupBy(*PAGE).agg(F.count("*").alias("__n")), PAGE, "left")
    taken = whole_pages_until(counted, ["page_no"], "__n", budget, by=["doc_id"]).select(*PAGE)
    place = F.row_number().over(W.partitionBy(*PAGE).orderBy("xref"))
    found = images.join(taken, PAGE).withColumn("image_no", place)
    return found.withColumn("image_name", F.format_string("page%d_%d.png", F.col("page_no"), F.col("image_no")))


def prepared(images: DataFrame, column: str = "pixels") -> DataFrame:
    """Images with `content`, the file of the image inverted where black exceeds white, and masked. column: its file as extracted."""
    ship(images.sparkSession)
    width, height = ("width", "height") if {"width", "height"} & set(images.columns) else (None, None)
    plain = images.drop(*(c for c in (width, height) if c))
    decoded = raster.decode(plain.withColumnRenamed(column, "__file"), "__file", (raster.inverted, raster.masked)).where("pixels is not null")

    def files(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sizes = zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), batch.column("pixels").to_pylist(), strict=True)
            made = [raster.png(np.frombuffer(data, np.uint8).reshape(h, w, 3)) for h, w, data in sizes]
            names = [n for n in batch.schema.names if n not in ("width", "height", "pixels")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(made, pa.binary())], [*names, "content"])

    kept = [f for f in decoded.schema if f.name not in ("width", "height", "pixels")]
    return decoded.mapInArrow(files, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "content binary"]))


@dataclass
class Files(WriterCommitMessage):
    """(temporary path, final path) of a task's files, and the documents they belong to."""

    names: list[tuple[str, str]]
    docs: list[str]


class TrainingWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex
        system, _, folder = self._pending()
        system.create_dir(folder, recursive=True)  # here and not in a task: one that is still at work when the run is aborted can't make it again

    def _pending(self) -> tuple[fs.FileSystem, str, str]:
        system, root = file_system(self.path)
        root = root.rstrip("/")
        return system, root, f"{root}/_pending-{self.run}"

    def write(self, rows: Iterator) -> Files:
        system, root, folder = self._pending()
        done, docs = [], set()
        for row in rows:
            if None in (row.doc_id, row.split, row.image_name, row.content, row.label):
                continue
            docs.add(row.doc_id)
            label = row.image_name.rsplit(".", 1)[0] + ".txt"
            for kind, name, data in (("images", row.image_name, bytes(row.content)), ("labels", label, row.label.encode())):
                now = f"{folder}/{uuid.uuid4().hex}"
                with system.open_output_stream(now) as out:
                    out.write(data)
                done.append((now, f"{root}/{row.doc_id}/{kind}/{row.split}/{name}"))
        return Files(done, sorted(docs))

    def commit(self, messages: list[Files | None]) -> None:
        system, root, folder = self._pending()
        found = [m for m in messages if m]
        for doc in sorted({d for m in found for d in m.docs}):
            for kind in ("images", "labels"):
                for split in ("train", "val"):
                    system.create_dir(f"{root}/{doc}/{kind}/{split}", recursive=True)
            with system.open_output_stream(f"{root}/{doc}/dataset.yaml") as out:
                out.write(description(f"{root}/{doc}").replace("images/split=", "images/").encode())
        for m in found:
            for now, to in m.names:
                system.move(now, to)
        self._clear()
        with system.open_output_stream(f"{root}/_counts-{self.run}.json") as out:
            names = {to for m in found for _, to in m.names}
            out.write(json.dumps({kind: sum(f"/{kind}/" in n for n in names) for kind in ("images", "labels")}).encode())

    def abort(self, messages: list[Files | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, _, folder = self._pending()
        remove(system, folder)


class TrainingSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> TrainingWriter:
        return TrainingWriter(self.options["path"])


def split_of(name, train: float = 0.8):
    """Train or val, by a stable hash of the name."""
    bucket = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")
    return F.when(bucket < int(train * 2**32), "train").otherwise("val")


def write_files(rows: DataFrame, path: str, train: float = 0.8) -> dict[str, int]:
    """A2, A3: writes rows (doc_id, image_name, content, label) and returns how many images and labels there are of this run."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(TrainingSet)
    system, root = file_system(path)
    system.create_dir(root.rstrip("/"), recursive=True)
    before = {f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("_counts-")}
    named = rows.select("doc_id", split_of(F.concat_ws("/", "doc_id", "image_name"), train).alias("split"), "image_name", "content", "label")
    named.write.format(NAME).option("path", path).mode("append").save()
    (mine,) = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("_counts-") and f.path not in before]
    with system.open_input_stream(mine) as f:
        counts = json.loads(f.read())
    system.delete_file(mine)
    return counts


def q_harvested_images(spark: SparkSession, d: str) -> DataFrame:
    """Customers are books, orders of odd keys their detail pages, lines the images; whole pages until five images."""
    pages = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").cast("int").alias("page_no"), F.when(F.col("o_orderkey") % 2 == 1, DETAIL).otherwise("Game Results").alias("text"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("int").alias("page_no"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("a"), F.col("l_suppkey").alias("b")).distinct()
    images = lines.join(pages.select(*PAGE), "page_no").select(*PAGE, F.struct("a", "b").alias("xref"))
    return harvest(pages, images, 5).select("doc_id", "image_name", F.col("xref.a").cast("long").alias("a"), F.col("xref.b").cast("long").alias("b"))


QUERIES = {"harvested_images": q_harvested_images}
ORACLE_SQL = {
    "harvested_images": """WITH i AS (SELECT DISTINCT l_orderkey AS p, l_linenumber * 1000000 + l_partkey AS a, l_suppkey AS b FROM lineitem), n AS (SELECT o_custkey AS d, o_orderkey AS p, (SELECT count(*) FROM i WHERE i.p = o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 1),
t AS (SELECT d, p, coalesce(sum(n) OVER (PARTITION BY d ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT CAST(d AS VARCHAR) AS doc_id, 'page' || p || '_' || row_number() OVER (PARTITION BY p ORDER BY a, b) || '.png' AS image_name, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM t JOIN i USING (p) WHERE before < 5""",
}
