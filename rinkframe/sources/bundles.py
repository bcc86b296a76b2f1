"""Books as bundles, read and written by a data source `result_book` with a partition for each range of a file.

A bundle is a zip file for a book, as a page extractor leaves it: `0001.txt` is the text of page 1, `0001.cells.json` its table cells
(a list of objects with the columns of the layer page_cells), `0001.images.json` its images (those of page_images) and `0001.7.png` the file of the image with xref 7.
doc_id is the file's name without `.zip`, which may be written in either case.

Reading. The driver lists files with their sizes and opens none; files are cut into ranges of `bytes`, and small files share a task. A task reads
the directory at the end of a file and then those entries alone that begin in its range, so no byte of a page is read twice and a large book is read by many tasks. A condition given to read_books is pushed:
what it says of doc_id (=, in, starts with) leaves out files before they are cut, and of page_no entries before they are inflated.
Readers open paths with pyarrow's file systems (local, hdfs, s3, gs).

Writing. Rows of one layer, clustered by book; each task writes its books under names of its own, and the driver gives them their names
at the end: a failed or aborted write leaves no bundle.

Options: path, layer (page_text, page_cells, page_images or page_problems), bytes (of a range), damaged (fail or skip), pixels (false: leave the files of images out).

Defined results: a page without an entry of the layer has no row; an empty folder, an empty bundle and a list without objects give no rows; a
file that is cut or no zip file and an entry that is damaged, no UTF-8 or no list fail the read, or are skipped and listed by the layer
page_problems (doc_id, page_no or null, reason); missing fields are null, others are ignored; entries with other names are ignored; written
rows without a doc_id or page number, and null texts, are left out; of a page's repeated texts the last in the data stays.
"""

from __future__ import annotations

import io
import json
import re
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from rinkframe.operators import scores
from rinkframe.schemas import LAYERS
from rinkframe.session import shared_folder, ship, table

NAME = "result_book"
#: Bytes of a bundle for a task, and of rows for a batch.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: Tasks of a read beyond which ranges grow (to RANGE_BYTES at most), and renames that a commit has under way at once.
TASKS, RENAMES = 256, 16
ENTRIES = {"page_text": r"(\d+)\.txt", "page_cells": r"(\d+)\.cells\.json", "page_images": r"(\d+)\.images\.json", "page_problems": r"(\d+)\.(?:txt|cells\.json|images\.json|\d+\.png)"}
PROBLEMS = StructType([StructField("doc_id", StringType()), StructField("page_no", IntegerType()), StructField("reason", StringType())])


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"file:/|/|\.|[^:]*$", path):
        return fs.LocalFileSystem(), re.sub(r"^file:(//)?(?=/)", "", path)
    return fs.FileSystem.from_uri(path)


def remove(system: fs.FileSystem, folder: str, tries: int = 5) -> None:
    """Deletes a folder; a task that is just being stopped may still be at work in it."""
    for k in range(tries):
        if system.get_file_info(folder).type != fs.FileType.Directory:
            return
        try:
            system.delete_dir(folder)
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(0.2)


class Seekable(io.RawIOBase):
    """An Arrow file for zipfile, which expects an OSError where it seeks before the first byte of a short file."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.total = file, file.size()

    def seek(self, at: int, whence: int = 0) -> int:
        place = at + (0, self.file.tell(), self.total)[whence]
        if place < 0:
            raise OSError("before the first byte")
        return self.file.seek(place)

    def tell(self) -> int:
        return self.file.tell()

    def read(self, n: int = -1) -> bytes:
        return self.file.read() if n is None or n < 0 else self.file.read(n)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True


def doc_of(path: str) -> str:
    return path.rsplit("/", 1)[-1][: -len(".zip")]


def layer_schema(layer: str) -> StructType:
    return PROBLEMS if layer == "page_problems" else LAYERS[layer]


@dataclass
class Ranges(InputPartition):
    """What a task reads: (path, first byte, end) of one or more files."""

    pieces: list[tuple[str, int, int]]


def ranges(files: list[tuple[str, int]], most: int) -> list[Ranges]:
    """Files cut into pieces of at most `most` bytes, of nearly equal size; pieces that fit together share a task. What would take more than TASKS tasks is cut into larger pieces, so that small ranges don't make
    a task, and an opening of the file, for every few entries of a large folder."""
    out, held, size = [], [], 0
    most = max(most, min(RANGE_BYTES, -(-sum(total for _, total in files) // TASKS)))
    for path, total in sorted(files):
        n = max(1, -(-total // most))
        for k in range(n):
            piece = (path, total * k // n, total * (k + 1) // n if k < n - 1 else total + 1)
            if held and size + piece[2] - piece[1] > most:
                out.append(Ranges(held))
                held, size = [], 0
            held.append(piece)
            size += piece[2] - piece[1]
    return out + ([Ranges(held)] if held else [])


def holds(f, value) -> bool:
    """Whether a pushed filter lets a value pass."""
    match f:
        case EqualTo() | EqualNullSafe():
            return value == f.value
        case In():
            return value in f.value
        case StringStartsWith():
            return value.startswith(f.value)
        case GreaterThan():
            return value > f.value
        case GreaterThanOrEqual():
            return value >= f.value
        case LessThan():
            return value < f.value
        case LessThanOrEqual():
            return value <= f.value
        case IsNotNull():
            return True
    raise ValueError(f"not a filter of this source: {f}")


class BookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.layer = options["path"], options.get("layer", "page_text")
        self.most, self.skip, self.pixels = int(options.get("bytes", RANGE_BYTES)), options.get("damaged", "fail") == "skip", options.get("pixels", "true") == "true"
        self.on: dict[str, list] = {"doc_id": [], "page_no": []}

    def partitions(self) -> list[Ranges]:
        system, root = file_system(self.path)
        here = system.get_file_info(root)
        found = [here] if here.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root))
        files = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(".zip") and all(holds(x, doc_of(f.path)) for x in self.on["doc_id"])]
        return ranges(files, self.most) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        schema, held, size = layer_schema(self.layer), [], 0
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
        of = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), of, strict=True)], schema=of)
        for path, start, end in partition.pieces:
            for row in self.rows(path, start, end):
                held.append(row)
                size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
                if size > BATCH_BYTES:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    def rows(self, path: str, start: int, end: int) -> Iterator[tuple]:
        """Rows of the entries that begin in [start, end)."""
        system, at = file_system(self.path)[0], doc_of(path)
        problems = self.layer == "page_problems"
        with system.open_input_file(path) as file:
            try:
                bundle = zipfile.ZipFile(Seekable(file))
            except zipfile.BadZipFile:
                if problems and start == 0:
                    yield at, None, "not a whole bundle"
                elif not problems and not self.skip:
                    raise
                return
            for info in bundle.infolist():
                name = re.fullmatch(ENTRIES[self.layer], info.filename)
                if not name or not start <= info.header_offset < end or not all(holds(f, int(name[1])) for f in self.on["page_no"]):
                    continue
                page = int(name[1])
                try:
                    found = list(self.page(bundle, info.filename, page, problems))
                except (zipfile.BadZipFile, zlib.error, EOFError, ValueError, NotImplementedError) as e:  # ValueError: neither UTF-8 nor a list
                    if problems:
                        yield at, page, f"{info.filename}: {type(e).__name__}"
                    elif not self.skip:
                        raise ValueError(f"{path}: {info.filename} is damaged") from e
                    continue
                if not problems:
                    yield from ((at, page, *r) for r in found)

    def page(self, bundle: zipfile.ZipFile, name: str, page: int, problems: bool) -> Iterator[tuple]:
        data = bundle.read(name)
        if name.endswith(".txt"):
            yield (data.decode(),)
        elif name.endswith(".json"):
            columns = LAYERS["page_cells" if name.endswith(".cells.json") else "page_images"].fieldNames()[2:]
            listed = json.loads(data)
            if not isinstance(listed, list) or not all(isinstance(x, dict) for x in listed):
                raise ValueError("no list of objects")
            for x in listed:
                if columns[-1] == "pixels":
                    file = f"{name.split('.')[0]}.{x.get('xref')}.png"
                    x["pixels"] = bundle.read(file) if self.pixels and not problems and file in bundle.NameToInfo else None
                yield tuple(x.get(c) for c in columns)


class PrunedReader(BookReader):
    def pushFilters(self, filters):
        """Filters on doc_id and page_no are all done here. Not on page_no for problems, where it may be null."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            fits = isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull)) or column == "page_no" and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or column == "doc_id" and isinstance(f, StringStartsWith)
            if column in self.on and fits and not (column == "page_no" and self.layer == "page_problems"):
                self.on[column].append(f)
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    """(temporary path, final path) of a task's bundles."""

    files: list[tuple[str, str]]


class BookWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.layer, self.overwrite, self.run = options["path"], options.get("layer", "page_text"), overwrite, uuid.uuid4().hex
        system, root = file_system(self.path)
        system.create_dir(self.pending(root), recursive=True)  # here and not in a task: one that is still at work when the run is aborted can't make it again

    def pending(self, root: str) -> str:
        return f"{root.rstrip('/')}/_pending-{self.run}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        folder = self.pending(root)
        done, book, files = [], None, {}

        def close() -> None:
            if book is None:
                return
            name = f"{folder}/{uuid.uuid4().hex}"
            with system.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as bundle:
                for entry in sorted(files):
                    bundle.writestr(zipfile.ZipInfo(entry), files[entry] if isinstance(files[entry], (bytes, str)) else json.dumps(files[entry]), zipfile.ZIP_DEFLATED)
            done.append((name, f"{root.rstrip('/')}/{book}.zip"))

        columns = LAYERS[self.layer].fieldNames()[2:]
        own = [c for c in columns if c != "pixels"]
        for batch in batches:
            for doc, page_no, *values in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page_no", *columns)), strict=True):
                if doc is None or page_no is None:
                    continue
                if doc != book:
                    close()
                    book, files = doc, {}
                page = f"{page_no:04d}"
                if self.layer == "page_text":
                    if values[0] is not None:
                        files[f"{page}.txt"] = values[0]
                else:
                    kind = "cells" if self.layer == "page_cells" else "images"
                    row = dict(zip(columns, values, strict=True))
                    files.setdefault(f"{page}.{kind}.json", []).append({c: row[c] for c in own})
                    if kind == "images" and row["pixels"] is not None:
                        files[f"{page}.{row['xref']}.png"] = bytes(row["pixels"])
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        named = [f for m in messages if m for f in m.files]
        if len({to for _, to in named}) < len(named):
            self.abort(messages)
            raise ValueError("a book came from two tasks: cluster the rows by doc_id")
        if self.overwrite:
            keep = {to for _, to in named}
            for old in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.base_name.lower().endswith(".zip") and old.path not in keep:
                    system.delete_file(old.path)
        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(lambda f: system.move(*f), named))
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        system, root = file_system(self.path)
        remove(system, self.pending(root))


class ResultBook(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return layer_schema(self.options.get("layer", "page_text"))

    def reader(self, schema: StructType) -> BookReader:
        return (PrunedReader if self.options.get("pruned") == "true" else BookReader)(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> BookWriter:
        return BookWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ResultBook)


def read_books(spark: SparkSession, path: str, layer: str = "page_text", where: Column | None = None, **options) -> DataFrame:
    """A layer of all bundles of a folder, or of one bundle; with `where`, of those rows alone for which it holds.

    Only `where` reaches the source. Spark keeps one reader for a loaded frame, with the filters that were pushed last; frames that share it and filter
    differently would read each other's pages. Behind the condition on a row's number, which always holds, no further filter is pushed, so the frame can be used anywhere, as often as wanted.
    """
    register(spark)
    load = spark.read.format(NAME).options(path=path, layer=layer, **options)
    return load.load() if where is None else load.option("pruned", "true").load().where(where).where(F.monotonically_increasing_id() >= 0)


def write_books(rows: DataFrame, path: str, layer: str = "page_text", mode: str = "append") -> None:
    """Rows of a layer as bundles; a book's rows go to one task, in their pages' order."""
    register(rows.sparkSession)
    ordered = rows.select(*LAYERS[layer].fieldNames()).repartition("doc_id").sortWithinPartitions("doc_id", "page_no")
    ordered.write.format(NAME).options(path=path, layer=layer).mode(mode).save()


def _page_bundles(spark: SparkSession, d: str) -> str:
    """Books of up to 50 pages made from the web pages, as bundles."""
    pages = table(spark, d, "pages").select(F.format_string("b%05d", F.floor(F.col("page_id") / 50)).alias("doc_id"), (F.col("page_id") % 50 + 1).cast("int").alias("page_no"), F.col("html").alias("text"))
    folder = shared_folder(spark, "bundles")
    write_books(pages, folder)
    return folder


def q_bundle_pages(spark: SparkSession, d: str) -> DataFrame:
    """S3: every page of every book, each file read in ranges of 16 kB."""
    return read_books(spark, _page_bundles(spark, d), bytes=16_384).select("doc_id", "page_no", F.md5("text").alias("digest"))


def q_bundle_page_range(spark: SparkSession, d: str) -> DataFrame:
    """S3: pages 10 to 40 of some books; other files and entries aren't read."""
    wanted = F.col("doc_id").startswith("b0000") & F.col("page_no").between(10, 40)
    return read_books(spark, _page_bundles(spark, d), where=wanted, bytes=16_384).select("doc_id", "page_no", F.length("text").cast("long").alias("n_chars"))


def q_bundle_cells(spark: SparkSession, d: str) -> DataFrame:
    """Table cells through bundles, to the score table of each page."""
    folder = shared_folder(spark, "bundles")
    write_books(scores.stand_in_cells(spark, d), folder, "page_cells")
    return scores.pick_table(read_books(spark, folder, "page_cells", bytes=65_536)).select("doc_id", "page_no", "table_no", "row_no", "col_no", "cell")


QUERIES = {"bundle_pages": q_bundle_pages, "bundle_page_range": q_bundle_page_range, "bundle_cells": q_bundle_cells}
_BOOK = "SELECT 'b' || lpad(CAST(page_id // 50 AS VARCHAR), 5, '0') AS doc_id, CAST(page_id % 50 + 1 AS INT) AS page_no"
ORACLE_SQL = {
    "bundle_pages": f"{_BOOK}, md5(html) AS digest FROM pages WHERE html IS NOT NULL",
    "bundle_page_range": f"{_BOOK}, length(html) AS n_chars FROM pages WHERE html IS NOT NULL AND page_id < 500 AND page_id % 50 BETWEEN 9 AND 39",
    "bundle_cells": scores.ORACLE_SQL["score_table_cells"],
}
