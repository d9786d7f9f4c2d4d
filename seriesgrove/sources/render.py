"""Slices as PNG files with an overlay, and the series forest as text or HTML."""

from __future__ import annotations

import html
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..operators import volumes

AXES = {"x": 2, "y": 1, "z": 0}


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB image, (rows, columns, 3)."""
    rows, cols, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.concatenate([np.zeros((rows, 1), np.uint8), rgb.astype(np.uint8).reshape(rows, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def shaded(a: np.ndarray) -> np.ndarray:
    """Values scaled from the least to the greatest, 0 to 255; a constant image is 0."""
    low, high = float(a.min()), float(a.max())
    return np.zeros(a.shape) if high <= low else (a - low) / (high - low) * 255


def overlaid(grey: np.ndarray, mask: np.ndarray | None, alpha: float, colour: tuple[int, int, int] = (255, 0, 0)) -> np.ndarray:
    rgb = np.repeat(grey[..., None], 3, axis=-1)
    if mask is not None:
        rgb = np.where((mask > 0)[..., None], (1 - alpha) * rgb + alpha * np.array(colour, float), rgb)
    return np.floor(rgb + 0.5)


def slice_images(images: DataFrame, masks: DataFrame | None = None, axis: str = "z", every: int = 10, alpha: float = 0.3) -> DataFrame:
    """(series, axis, position, content): every n-th slice of each volume as PNG, with the mask of the same series laid over it."""
    if axis not in AXES or every < 1 or not 0 <= alpha <= 1:
        raise ValueError("axis is x, y or z, every 1 or more, alpha 0 to 1")
    rows = images.select("series", "size", "voxels")
    if masks is not None:
        rows = rows.join(masks.select("series", F.col("voxels").alias("mask"), F.col("size").alias("mask_size")), "series", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each(b: pd.DataFrame) -> Iterator[tuple]:
            for r in b.to_dict("records"):
                grey = shaded(volumes.array_of(r["voxels"], r["size"]))
                m = volumes.array_of(r["mask"], r["mask_size"]) if isinstance(r.get("mask"), bytes) else None
                for i in range(0, grey.shape[AXES[axis]], every):
                    yield r["series"], axis, i, png(overlaid(np.take(grey, i, AXES[axis]), None if m is None else np.take(m, i, AXES[axis]), alpha))

        for b in batches:
            yield from volumes.batched(each(b), ["series", "axis", "position", "content"])

    return rows.mapInPandas(run, "series string, axis string, position int, content binary")


def export(slices: DataFrame, folder: str) -> DataFrame:
    """Writes slice images below a folder, one name per slice; stored rows (path)."""
    root = storage.qualified(slices.sparkSession, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                goal = f"{root}/{r.series}/{r.axis}_{r.position:04d}.png"
                part = f"{goal}.{storage.attempt_name()}.part"
                storage.write_bytes(part, r.content)
                storage.move(part, goal)
                out.append(goal)
            yield pd.DataFrame({"path": out})

    return storage.stored(slices.sparkSession, slices.mapInPandas(run, "path string"), "slices")


def tree_rows(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """pid, depth, uid, modality, parent, path: every node under each root, ordered as a tree by patient."""
    last = F.element_at("path", -1)
    rows = paths.select("pid", F.size("path").alias("depth"), last["uid"].alias("uid"), last["modality"].alias("modality"), F.get("path", F.size("path") - 2)["uid"].alias("parent"), "path")
    return rows.orderBy("pid", F.transform("path", lambda p: p["uid"]))


def tree_text(rows: DataFrame, most: int = 10_000) -> str:
    """The tree as indented text, up to ``most`` nodes (a report for people)."""
    out, pid = [], object()
    for r in rows.limit(most).toLocalIterator():
        if r.pid != pid:
            pid = r.pid
            out.append(str(pid))
        out.append("  " * r.depth + f"{r.modality} {r.uid}")
    return "\n".join(out)


def tree_html(rows: DataFrame, most: int = 10_000) -> str:
    """The tree as nested HTML lists, up to ``most`` nodes (a report for people)."""
    out, depth, pid = ["<!DOCTYPE html><html><head><meta charset='utf-8'><title>Series</title></head><body>"], 0, None
    for r in rows.limit(most).toLocalIterator():
        if r.pid != pid:
            out.append("</ul>" * depth + f"<h2>{html.escape(str(r.pid))}</h2>")
            depth, pid = 0, r.pid
        out.append("<ul>" * max(r.depth - depth, 0) + "</ul>" * max(depth - r.depth, 0) + f"<li><b>{html.escape(r.modality)}</b> {html.escape(str(r.uid))}</li>")
        depth = r.depth
    return "".join([*out, "</ul>" * depth, "</body></html>"])
