"""NIfTI-1 volumes: encoder, decoder, and templated writing from a DataFrame."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the NIfTI-1 format.
CODES = {"uint8": 2, "int16": 4, "int32": 8, "float32": 16, "float64": 64, "int8": 256, "uint16": 512, "uint32": 768, "int64": 1024}
HEADER, OFFSET = 348, 352


def encode(voxels: np.ndarray, spacing: tuple = (1, 1, 1), origin: tuple = (0, 0, 0), direction: tuple = (1, 0, 0, 0, 1, 0, 0, 0, 1), level: int = 9) -> bytes:
    """A gzip NIfTI of a (z, y, x) array; world axes turn from left-posterior to right-anterior."""
    nz, ny, nx = voxels.shape
    h = bytearray(OFFSET)
    struct.pack_into("<i", h, 0, HEADER)
    struct.pack_into("<8h", h, 40, 3, nx, ny, nz, 1, 1, 1, 1)
    struct.pack_into("<2h", h, 70, CODES[str(voxels.dtype)], voxels.dtype.itemsize * 8)
    struct.pack_into("<8f", h, 76, 1, *spacing, 0, 0, 0, 0)
    struct.pack_into("<3f", h, 108, OFFSET, 1, 0)
    struct.pack_into("<2h", h, 252, 0, 1)
    m = np.array(direction, float).reshape(3, 3) * np.array(spacing, float)
    affine = np.concatenate([m, np.array(origin, float)[:, None]], axis=1) * np.array([[-1], [-1], [1]])
    struct.pack_into("<12f", h, 280, *affine.ravel())
    h[344:348] = b"n+1\x00"
    return gzip.compress(bytes(h) + np.ascontiguousarray(voxels).astype(voxels.dtype.newbyteorder("<")).tobytes(), level, mtime=0)


def decode_image(data: bytes) -> tuple[np.ndarray, tuple, tuple, tuple]:
    """(z, y, x) array, spacing, origin, direction (row-major)."""
    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    nx, ny, nz = struct.unpack_from("<3h", raw, 42)
    name = {v: k for k, v in CODES.items()}[struct.unpack_from("<h", raw, 70)[0]]
    at = int(struct.unpack_from("<f", raw, 108)[0])
    affine = np.array(struct.unpack_from("<12f", raw, 280)).reshape(3, 4) * np.array([[-1], [-1], [1]])
    spacing = struct.unpack_from("<3f", raw, 80)
    voxels = np.frombuffer(raw, np.dtype(name).newbyteorder("<"), nx * ny * nz, at).reshape(nz, ny, nx)
    return voxels, spacing, tuple(affine[:, 3]), tuple((affine[:, :3] / np.array(spacing)).ravel())


def decode(data: bytes) -> tuple[np.ndarray, tuple, tuple]:
    """(z, y, x) array, spacing, origin."""
    return decode_image(data)[:3]


def encode_rows(rows: DataFrame, values: str, shape: tuple[int, int, int], dtype: str = "float32") -> DataFrame:
    """series, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"series": b["series"], "content": [encode(np.asarray(v, dtype=dtype).reshape(shape[::-1])) for v in b[values]]})

    return rows.select("series", values).mapInPandas(run, "series string, content binary")


def roundtrip(rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """series, n_voxels, total after writing and reading back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = [decode(c)[0] for c in b["content"]]
            yield pd.DataFrame({"series": b["series"], "n_voxels": [v.size for v in read], "total": [float(v.sum(dtype=np.float64)) for v in read]})

    found = encode_rows(rows, "embedding", shape).mapInPandas(run, "series string, n_voxels long, total double")
    return found.withColumn("total", F.round("total", 4))


#: What an image's own statistics are called; they never come from supplied metadata.
FINGERPRINT = ("hash", "size", "n_voxels", "spacing", "origin", "direction", "dtype", "v_min", "v_max", "v_sum", "v_mean", "v_std", "v_var")


def read_images(files: DataFrame, metadata: str | None = None, mask: bool = False) -> DataFrame:
    """Volume rows of saved images in (path), with what else ``files`` has; supplied metadata loses fingerprint keys, and ``mask.`` keys for masks.

    A file that can't be read is a row with an error; a mask that isn't stored
    as unsigned bytes has a warning.
    """
    from .. import storage
    from ..operators import volumes

    grid = {"size": "array<int>", "spacing": "array<double>", "origin": "array<double>", "direction": "array<double>", "voxels": "binary", "dtype": "string", "warning": "string"}
    rows = files.select("*", *[F.lit(None).cast(k).alias(c) for c, k in grid.items()])

    def one(r: dict) -> dict:
        a, spacing, origin, direction = decode_image(storage.read_bytes(r["path"]))
        warning = f"a mask stored as {a.dtype}" if mask and a.dtype != np.uint8 else None
        return {"size": list(a.shape[::-1]), "spacing": list(map(float, spacing)), "origin": list(map(float, origin)), "direction": list(map(float, direction)),
                "voxels": a.astype("<f4").tobytes(), "dtype": str(a.dtype), "warning": warning}

    out = volumes.map_rows(rows, one, "LoadError")
    if metadata:
        out = out.withColumn(metadata, F.map_filter(metadata, lambda k, v: ~(k.isin(*FINGERPRINT) | (F.startswith(k, F.lit("mask.")) if mask else F.lit(False)))))
    return out
