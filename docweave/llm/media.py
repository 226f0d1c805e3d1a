"""Media columns: bytes stored losslessly in progressive JPEG images, and images decoded to RGB tensors.

A payload's bytes become quantised DCT coefficients (the format's unit; all quantisers are 1): byte b is the
coefficient v = b - CENTRE moved away from zero by 2, so that every scan of the progressive image is regular.  The
blocks fill the Y plane in raster order, then Cb, then Cr; blocks that an image needs beyond the payload hold zeros.
The number of bytes is kept in a comment.  Reading decodes all scans to coefficients, which give the bytes back, and
to a full-resolution RGB tensor, of which the feature is taken.

Defined results: a null text is as an empty one; an empty payload is padded to 64 zero bytes; equal bytes give equal
images; rows with equal or null ids and repeated rows are stored each for itself; a very long payload becomes one image
(of 2 GB of payload at most); columns named as the operator's own are replaced, all others stay; an empty table gives an
empty one.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg, kit

CENTRE, UNIT = 108, 6
ENCODE_BYTES, DECODE_BYTES = 1 << 20, 4 << 20


def shape_of(blocks: int) -> tuple[int, int]:
    """Rows and columns of 16-pixel units that hold so many blocks."""
    units = max(1, -(-blocks // UNIT))
    columns = int(np.ceil(np.sqrt(units)))
    return -(-units // columns), columns


def store(payloads: list[bytes]) -> list[bytes]:
    """An image for each payload."""
    images, shapes, notes = [], [], []
    for payload in payloads:
        rows, columns = shape_of(-(-max(1, len(payload)) // 64))
        units = rows * columns
        full = np.zeros(units * UNIT * 64, np.uint8)
        full[: len(payload)] = np.frombuffer(payload, np.uint8)
        value = full.astype(np.int16) - CENTRE
        value += np.where(value < 0, -2, 2).astype(np.int16)
        value = value.reshape(-1, 64)
        images.append((value[: 4 * units], value[4 * units : 5 * units], value[5 * units :]))
        shapes.append((rows, columns))
        notes.append(struct.pack(">Q", len(payload)))
    return jpeg.encode(images, shapes, notes)


def load(data: list[bytes]) -> tuple[list[jpeg.Image], np.ndarray]:
    images = [jpeg.parse(x) for x in data]
    return images, jpeg.decode_coefficients(images)


def payload_of(image: jpeg.Image, coefficients: np.ndarray) -> bytes:
    """The bytes that store() put into an image."""
    n = struct.unpack(">Q", image.comment)[0]
    own = coefficients[image.components[0].at :].reshape(-1)[:n]
    return (own + np.where(own < 0, 2, -2) + CENTRE).astype(np.uint8).tobytes()


def tensors(images: list[jpeg.Image], coefficients: np.ndarray) -> list[np.ndarray]:
    """Full-resolution RGB tensors (rows, columns, 3)."""
    return [jpeg.to_rgb(i, jpeg.samples(i, coefficients)) for i in images]


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean of each channel, and a hash of the signs of brightness steps between 8 x 9 areas."""
    flat = rgb.reshape(-1, 3)
    mean = flat.sum(0, dtype=np.int64) / len(flat)
    rows, columns = (np.linspace(0, n, k + 1).astype(int)[:-1] for n, k in zip(rgb.shape[:2], (8, 9), strict=True))
    area = np.add.reduceat(np.add.reduceat(rgb[:, :, 1].astype(np.int64), rows, 0), columns, 1)
    signs = np.packbits(area[:, 1:] > area[:, :-1]).tobytes().hex()
    return f"{rgb.shape[0]}x{rgb.shape[1]}:" + ",".join(f"{m:.3f}" for m in mean) + f":{signs}"


def _stored(batches):
    for batch in batches:
        raw, offs = kit.flat(batch["payload"])
        data, media = raw.tobytes(), []
        for i, j in kit.slices(offs, ENCODE_BYTES):
            media += store([data[a:b] for a, b in zip(offs[i:j].tolist(), offs[i + 1 : j + 1].tolist(), strict=True)])
        keep = [n for n in batch.schema.names if n != "payload"]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in keep), pa.array(media, pa.binary())], names=[*keep, "media"])


def store_media(rows: DataFrame) -> DataFrame:
    """rows with the binary column payload stored in the binary column media instead."""
    rows = rows.drop("media")
    return rows.mapInArrow(kit.lean(_stored), kit.with_fields(rows.drop("payload"), media="binary"))


def _opened(images: bool):
    def run(batches):
        for batch in batches:
            _, offs = kit.flat(batch["media"])
            for i, j in kit.slices(offs, DECODE_BYTES):
                part = batch.slice(i, j - i)
                found, coefficients = load(part["media"].to_pylist())
                columns = [pa.array([payload_of(x, coefficients) if x.comment else None for x in found], pa.binary())]
                rgb = [jpeg.to_rgb(x, jpeg.samples(x, coefficients)) for x in found] if images else ()
                if images:
                    columns += [pa.array([x.height for x in found], pa.int32()), pa.array([x.width for x in found], pa.int32()), pa.array([x.tobytes() for x in rgb], pa.binary())]
                else:
                    columns += [pa.array([feature_of(jpeg.to_rgb(x, jpeg.samples(x, coefficients))) for x in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*batch.schema.names, "payload", *(("height", "width", "rgb") if images else ("feature",))])

    return run


def open_media(rows: DataFrame, images: bool = True) -> DataFrame:
    """rows with payload and, of their progressive images, height, width and rgb (bytes of the full-resolution tensor),
    or with images=False the feature alone.  Images that store_media() did not write have a null payload."""
    added = {"payload": "binary"} | ({"height": "int", "width": "int", "rgb": "binary"} if images else {"feature": "string"})
    rows = rows.drop(*added)
    return rows.mapInArrow(kit.lean(_opened(images)), kit.with_fields(rows, **added))


def op7_media(spark, sf_dir: str) -> DataFrame:
    kit.bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("payload"))
    docs = docs.withColumn("n_bytes", F.octet_length("payload").cast("long"))
    size = F.greatest(F.ceil(F.col("n_bytes") / 64), F.lit(1)) * 64
    padded = F.concat("payload", F.unhex(F.repeat(F.lit("00"), (size - F.col("n_bytes")).cast("int"))))
    back = open_media(store_media(docs.withColumn("payload", padded)), images=False)
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
