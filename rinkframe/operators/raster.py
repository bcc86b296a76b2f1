"""Images as pixels: PNG files decoded and written, turned, inverted, masked, cropped and resized in Arrow batches.

A picture is a uint8 array of height x width x 3. Its file is decoded by inflating its rows and undoing their filters along diagonals: a byte depends on its left,
upper and upper-left neighbours alone, so all places of a diagonal are undone at once, whatever filters the rows have.

Defined results: grey values stand for all three components, a palette's colours for its numbers, transparency is left out, of 16 bits the upper 8 stay, fewer bits are
scaled up to 255; null, cut, damaged and interlaced files and those that are no PNG decode to null; in frames such an image keeps its row with null pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkframe.session import ship, table

# Fixed values of the format: signature, components of each colour type.
SIGNATURE, COMPONENTS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: The size of a sheet, and what is white before an image is learned from: the first and last rows, all columns but the first and the last two.
WIDTH, HEIGHT, MASKED = 300, 600, (20, 19)
#: Weights of a resized pixel's neighbours are whole numbers of 1 / ONE.
ONE = 2048


def unfiltered(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Rows of filtered bytes (height x width in bytes) as they were; step: bytes of a pixel."""
    h, n = rows.shape
    w = -(-n // step)
    x = np.zeros((h, w * step), np.int16)
    x[:, :n] = rows
    x = x.reshape(h, w, step)
    out = np.zeros((h + 1, w + 1, step), np.int16)  # a row above and a column to the left are zero
    kinds = kinds.astype(np.int16)[:, None]
    for d in range(h + w - 1):
        r = np.arange(max(0, d - w + 1), min(h, d + 1))
        c, k = d - r, kinds[r]
        left, up, both = out[r + 1, c], out[r, c + 1], out[r, c]
        guess = left + up - both
        a, b, e = abs(guess - left), abs(guess - up), abs(guess - both)
        paeth = np.where((a <= b) & (a <= e), left, np.where(b <= e, up, both))
        out[r + 1, c + 1] = (x[r, c] + np.choose(k, [0, left, up, (left + up) >> 1, paeth])) & 255
    return out[1:, 1:].reshape(h, -1)[:, :n].astype(np.uint8)


def filtered(pixels: np.ndarray, kinds: np.ndarray) -> bytes:
    """Rows of a picture with a filter kind for each, as a PNG file holds them before it deflates them."""
    h, w, step = pixels.shape
    x = np.zeros((h + 1, w + 1, step), np.int16)
    x[1:, 1:] = pixels
    own, left, up, both = x[1:, 1:], x[1:, :-1], x[:-1, 1:], x[:-1, :-1]
    guess = left + up - both
    a, b, e = abs(guess - left), abs(guess - up), abs(guess - both)
    paeth = np.where((a <= b) & (a <= e), left, np.where(b <= e, up, both))
    out = np.choose(kinds.astype(np.int16)[:, None, None], [own, own - left, own - up, own - ((left + up) >> 1), own - paeth]) & 255
    return np.concatenate([kinds.astype(np.uint8)[:, None], out.astype(np.uint8).reshape(h, -1)], 1).tobytes()


def png(pixels: np.ndarray, kinds: np.ndarray | None = None) -> bytes:
    """A PNG file of height x width x components (1 to 4) of 8 bits; without kinds each row gets the filter with the smallest sum of differences."""
    h, w, n = pixels.shape
    if kinds is None:
        tried = np.frombuffer(b"".join(filtered(pixels, np.full(h, k)) for k in range(5)), np.uint8).reshape(5, h, -1)[:, :, 1:].astype(np.int8)
        kinds = np.abs(tried.astype(np.int32)).sum(2).argmin(0)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered(pixels, kinds), 6)) + chunk(b"IEND", b"")


def decoded(data: bytes | None) -> np.ndarray | None:
    """Height x width x 3 of a PNG file, or None."""
    if not data or not data.startswith(SIGNATURE):
        return None
    at, head, colours, packed = len(SIGNATURE), None, None, []
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or zlib.crc32(name + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            return None
        at += 12 + size
        if name == b"IHDR":
            if size != 13:
                return None
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            colours = np.frombuffer(body[: size // 3 * 3], np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
    else:
        return None
    if head is None or not head[0] or not head[1] or head[3] not in COMPONENTS or head[2] not in (1, 2, 4, 8, 16) or head[6]:
        return None
    w, h, bits, kind = head[:4]
    n = COMPONENTS[kind]
    size = -(-w * n * bits // 8)
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error:
        return None
    if len(raw) < h * (size + 1):
        return None
    rows = np.frombuffer(raw[: h * (size + 1)], np.uint8).reshape(h, size + 1)
    if rows[:, 0].max() > 4:
        return None
    x = unfiltered(rows[:, 1:], rows[:, 0], max(1, n * bits // 8))
    if bits == 16:
        x = x[:, ::2]
    elif bits < 8:
        x = np.unpackbits(x, axis=1).reshape(h, -1, bits)
        x = (x * (1 << np.arange(bits - 1, -1, -1))).sum(2).astype(np.uint8)
        if kind != 3:
            x = x * np.uint8(255 // ((1 << bits) - 1))
    x = x[:, : w * n].reshape(h, w, n)
    if kind == 3:
        if colours is None or x.max() >= len(colours):
            return None
        return colours[x[:, :, 0]]
    return x[:, :, :3].copy() if n > 2 else np.repeat(x[:, :, :1], 3, 2)


def inverted(x: np.ndarray) -> np.ndarray:
    """255 - x if there are more pixels of pure black than of pure white."""
    return 255 - x if (x == 0).all(2).sum() > (x == 255).all(2).sum() else x


def upright(x: np.ndarray) -> np.ndarray:
    """Turned round by 180 degrees if row 20 is black in all columns but the first and the last (of 300: 1 to 298)."""
    return x[::-1, ::-1] if x.shape[0] > 20 and x.shape[1] > 2 and not x[20, 1:-1].any() else x


def masked(x: np.ndarray) -> np.ndarray:
    """white in the first and last rows, but for the first and the last two columns."""
    x = x.copy()
    top, bottom = MASKED
    x[:top, 1:-2] = 255
    x[max(0, len(x) - bottom) :, 1:-2] = 255
    return x


def resized(x: np.ndarray, width: int = WIDTH, height: int = HEIGHT) -> np.ndarray:
    """bilinear, pixels by their centres; weights are whole numbers of 1 / ONE, halves round up."""

    def axis(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
        low = np.floor(place).astype(np.int64)
        return low, np.minimum(low + 1, n - 1), np.floor((place - low) * ONE + 0.5).astype(np.int64)

    (y0, y1, fy), (x0, x1, fx) = axis(x.shape[0], height), axis(x.shape[1], width)
    rows = x[y0].astype(np.int64) * (ONE - fy)[:, None, None] + x[y1] * fy[:, None, None]
    out = rows[:, x0] * (ONE - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]
    return ((out + ONE * ONE // 2) // (ONE * ONE)).astype(np.uint8)


def cropped(page: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray | None:
    """The part of a drawn page within a box of pixels (x0, y0, x1, y1), as far as it is on the page, in a sheet's size; None if nothing is."""
    x0, y0, x1, y1 = box
    part = page[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)]
    return resized(part) if part.size else None


PIXELS = "width int, height int, pixels binary"


def _with_pixels(images: DataFrame, column: str, change: Callable[[dict], np.ndarray | None], drop: tuple[str, ...] = ()) -> DataFrame:
    """images without `column` and `drop`, with width, height and pixels (rows of 3 bytes a pixel) of what change makes of a row, in small batches."""
    ship(images.sparkSession)
    kept = [f for f in images.schema if f.name not in (column, *drop)]
    if clash := {f.name for f in kept} & {"width", "height", "pixels"}:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), PIXELS])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 16):  # a picture has some hundred kB
                part = batch.slice(a, 16)
                found = [change(row) for row in part.to_pylist()]
                more = [pa.array([None if x is None else x.shape[1] for x in found], pa.int32()), pa.array([None if x is None else x.shape[0] for x in found], pa.int32()), pa.array([None if x is None else x.tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *more], [*(f.name for f in kept), "width", "height", "pixels"])

    return images.mapInArrow(run, schema)


def decode(images: DataFrame, column: str = "content", prepare: tuple[Callable[[np.ndarray], np.ndarray], ...] = (inverted,)) -> DataFrame:
    """The pixels of image files, each after what `prepare` lists (inverted, upright, masked, resized)."""

    def change(row: dict) -> np.ndarray | None:
        x = decoded(row[column])
        for f in prepare if x is not None else ():
            x = f(x)
        return x

    return _with_pixels(images, column, change)


def crops(pages: DataFrame, boxes: DataFrame, column: str = "content") -> DataFrame:
    """Of each drawn page (doc_id, page_no, file) the sheets in its recovered boxes (px0 to py1, see slots.recovered). A page's file meets all its boxes at once, so it is decoded once and goes through no shuffle but that of its page."""
    key = ["doc_id", "page_no"]
    of = boxes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "px0", "py0", "px1", "py1"))).alias("boxes"))
    met = pages.select(*key, column).join(of, key)
    ship(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*key, "x0", "y0", "width", "height", "pixels"]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                page = decoded(row[column])
                made = [] if page is None else [(b, cropped(page, (b["px0"], b["py0"], b["px1"], b["py1"]))) for b in row["boxes"]]
                made = made or [(b, None) for b in row["boxes"]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*((row["doc_id"], row["page_no"], b["x0"], b["y0"], *((None,) * 3 if x is None else (x.shape[1], x.shape[0], x.tobytes()))) for b, x in made), strict=True), (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names)

    return met.mapInArrow(run, f"doc_id string, page_no int, x0 double, y0 double, {PIXELS}")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as a picture file: 64 numbers become 8 x 8 grey or 4 x 4 x 4 pixels by the parity of its id, black or white where they are large, with filters by row."""
    ship(spark)
    level = F.transform("embedding", lambda x: F.when(x.cast("double") > 0.1, 255).when(x.cast("double") < -0.05, 0).otherwise(F.floor(x.cast("double") * 1000 + 100)).cast("int"))
    rows = table(spark, d, "embeddings").where("embedding is not null and size(embedding) = 64").select("vec_id", level.alias("level"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("level").to_pylist(), strict=True):
                x = np.array(x, np.uint8)
                made.append(png(x.reshape(8, 8, 1), (np.arange(8) + i) % 5) if i % 2 else png(x.reshape(4, 4, 4), (np.arange(4) + i) % 5))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(made, pa.binary())], ["vec_id", "content"])

    return rows.mapInArrow(run, "vec_id bigint, content binary")


def q_decoded_images(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's picture file, decoded, inverted where black exceeds white; a row for each pixel."""
    found = decode(_files(spark, d))
    byte = lambda k: F.conv(F.hex(F.substring("pixels", F.col("at") * 3 + k, F.lit(1))), 16, 10).cast("int")
    each = found.select("vec_id", "width", "height", "pixels", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("at"))
    return each.select("vec_id", "width", "height", "at", byte(1).alias("r"), byte(2).alias("g"), byte(3).alias("b"))


QUERIES = {"decoded_images": q_decoded_images}
ORACLE_SQL = {
    "decoded_images": """WITH l AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN CAST(x AS DOUBLE) > CAST(0.1 AS DOUBLE) THEN 255 WHEN CAST(x AS DOUBLE) < CAST(-0.05 AS DOUBLE) THEN 0 ELSE CAST(floor(CAST(x AS DOUBLE) * 1000 + 100) AS INT) END) AS v, CASE WHEN vec_id % 2 = 1 THEN 8 ELSE 4 END AS w FROM embeddings WHERE len(embedding) = 64),
p AS (SELECT vec_id, w, CAST(unnest(range(0, w * w)) AS INT) AS i, v FROM l),
c AS (SELECT vec_id, w, i, CASE WHEN w = 8 THEN v[i + 1] ELSE v[i * 4 + 1] END AS r, CASE WHEN w = 8 THEN v[i + 1] ELSE v[i * 4 + 2] END AS g, CASE WHEN w = 8 THEN v[i + 1] ELSE v[i * 4 + 3] END AS b FROM p),
n AS (SELECT vec_id, count(*) FILTER (r = 0 AND g = 0 AND b = 0) > count(*) FILTER (r = 255 AND g = 255 AND b = 255) AS dark FROM c GROUP BY 1)
SELECT vec_id, CAST(w AS INT) AS width, CAST(w AS INT) AS height, i AS at, CASE WHEN dark THEN 255 - r ELSE r END AS r, CASE WHEN dark THEN 255 - g ELSE g END AS g, CASE WHEN dark THEN 255 - b ELSE b END AS b FROM c JOIN n USING (vec_id)""",
}
