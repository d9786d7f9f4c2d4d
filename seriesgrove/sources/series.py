"""DICOM series to volumes: pixel decoding, slice order, geometry, and what each modality does to the values."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..errors import InvalidDicomError
from ..operators import volumes
from ..operators.crawl import sub_series
from . import dicom, pixels

IMAGE = (
    "series string, sub_series string, modality string, size array<int>, spacing array<double>, origin array<double>, direction array<double>, "
    "voxels binary, meta map<string,string>, error string"
)
NAMES = [c.split()[0] for c in IMAGE.replace("map<string,string>", "map").split(", ")]
#: Transfer syntaxes whose pixels are plain numbers.
PLAIN = (pixels.IMPLICIT, pixels.EXPLICIT, pixels.DEFLATED, pixels.BIG, "")


class PETImageType(str, Enum):
    """Which of a PET file's private factors scales the values; the tag that holds it is a fixed value."""

    SUV = "70531000"
    ACT = "70531009"


def numbers(v: object) -> list[float]:
    """A header value of one or several numbers."""
    if v is None or v == "":
        return []
    if isinstance(v, bytes):  # a private tag without a known representation
        v = v.decode("ascii", "replace").strip(" \x00").split("\\")
    return [float(x) for x in (v if isinstance(v, list) else [v])]


def number(v: object, default: float) -> float:
    got = numbers(v)
    return got[0] if got else default


def frames_of(h: dict) -> np.ndarray:
    """(frames, rows, columns) of the stored values."""
    raw, bits, syntax = h.get("PixelData"), int(number(h.get("BitsAllocated"), 16)), text_of(h.get("TransferSyntaxUID"))
    rows, cols, n = (int(number(h.get(k), d)) for k, d in (("Rows", 0), ("Columns", 0), ("NumberOfFrames", 1)))
    if int(number(h.get("SamplesPerPixel"), 1)) != 1:
        raise InvalidDicomError("only one sample per pixel is read")
    kind = f"{'i' if number(h.get('PixelRepresentation'), 0) else 'u'}{max(bits // 8, 1)}"
    if isinstance(raw, list):
        return pixels.decode(raw, syntax, n, rows, cols, max(bits // 8, 1), h.get("7FE00001")).view(f"<{kind}")
    if syntax not in PLAIN:
        raise InvalidDicomError(f"compressed pixels ({syntax}) are not read")
    if not isinstance(raw, bytes):
        raise InvalidDicomError("no pixel data")
    if bits == 1:
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: n * rows * cols].reshape(n, rows, cols)
    stored = np.dtype((">" if syntax == pixels.BIG else "<") + kind)
    if len(raw) < n * rows * cols * stored.itemsize:
        raise InvalidDicomError("the pixel data is too short")
    return np.frombuffer(raw, stored, n * rows * cols).reshape(n, rows, cols)


def text_of(v: object) -> str:
    return dicom.text(v).strip()


def axes(orientation: list[float]) -> np.ndarray:
    """The direction matrix: row, column and slice axes as its columns."""
    r, c = (np.array(orientation[:3]), np.array(orientation[3:6])) if len(orientation) == 6 else (np.array([1.0, 0, 0]), np.array([0, 1.0, 0]))
    return np.stack([r, c, np.cross(r, c)], axis=1)


def unevenness(headers: list[dict]) -> dict[str, str]:
    """What speaks against one regular grid: slices whose orientation differs, stand twice at a place, or whose steps differ (by over a hundredth)."""
    turns = [numbers(h.get("ImageOrientationPatient")) for h in headers]
    if any(len(t) != len(turns[0]) or not np.allclose(t, turns[0], atol=1e-3) for t in turns):
        return {"geometry": "the slices' orientations differ"}
    axis = axes(turns[0])[:, 2]
    at = sorted(float(np.dot(p, axis)) for p in (numbers(h.get("ImagePositionPatient")) for h in headers) if len(p) == 3)
    steps = np.diff(at)
    if len(at) < len(headers) or not len(steps) or np.ptp(steps) <= 0.01 * abs(np.median(steps)):
        return {}
    if (steps <= 1e-6).any():
        return {"geometry": f"{int((steps <= 1e-6).sum())} slices stand at another's place"}
    return {"geometry": f"steps between slices from {steps.min():.6g} to {steps.max():.6g}"}


def assemble(headers: list[dict]) -> tuple[np.ndarray, list[float], list[float], list[float]]:
    """(z, y, x) float32 values after the rescale of each slice, with spacing, origin and direction (row-major).

    Slices are ordered by their position along the slice axis, those of equal
    position by instance number; a slice without a position by instance number alone.
    """
    d = axes(numbers(headers[0].get("ImageOrientationPatient")))
    at = [numbers(h.get("ImagePositionPatient")) or [0.0, 0.0, number(h.get("InstanceNumber"), 0)] for h in headers]
    along = [float(np.dot(p, d[:, 2])) for p in at]
    order = sorted(range(len(headers)), key=lambda i: (along[i], number(headers[i].get("InstanceNumber"), 0)))
    planes = []
    for i in order:
        h = headers[i]
        planes.append(frames_of(h).astype(np.float32) * np.float32(number(h.get("RescaleSlope"), 1)) + np.float32(number(h.get("RescaleIntercept"), 0)))
    if len({p.shape[1:] for p in planes}) > 1:
        raise InvalidDicomError("the slices differ in size")
    row, col = (numbers(headers[0].get("PixelSpacing")) + [1.0, 1.0])[:2]
    offsets = numbers(headers[0].get("GridFrameOffsetVector"))
    gap = number(headers[0].get("SliceThickness"), 1.0) or 1.0
    if len(order) > 1:
        gap = (along[order[-1]] - along[order[0]]) / (len(order) - 1) or gap
    elif len(offsets) > 1:
        gap = abs(offsets[1] - offsets[0]) or gap
    return np.concatenate(planes), [col, row, gap], list(map(float, at[order[0]])), d.ravel().tolist()


def read_scan(headers: list[dict]) -> tuple[np.ndarray, list[float], list[float], list[float], dict[str, str]]:
    """CT or MR; a negative slice gap under a slice axis that doesn't point up flips the direction's last row."""
    a, spacing, origin, d = assemble(headers)
    if number(headers[0].get("SpacingBetweenSlices"), 0) < 0 and d[8] <= 0:
        d = [*d[:6], *(-x for x in d[6:])]
    return a, spacing, origin, d, {}


def read_pet(headers: list[dict], kind: PETImageType = PETImageType.SUV) -> tuple[np.ndarray, list[float], list[float], list[float], dict[str, str]]:
    """PET values times the private factor (1 if there is none), without sign."""
    a, spacing, origin, d = assemble(headers)
    factor = number(headers[0].get(kind.value), 1.0)
    return np.abs(a * np.float32(factor)), spacing, origin, d, {"factor": repr(factor)}


def read_dose(headers: list[dict]) -> tuple[np.ndarray, list[float], list[float], list[float], dict[str, str]]:
    """The dose grid of the first file times its scaling."""
    h = headers[0]
    a, spacing, origin, d = assemble(headers[:1])
    return a * np.float32(number(h.get("DoseGridScaling"), 1.0)), spacing, origin, d, {k: text_of(h.get(k)) for k in ("DoseUnits", "DoseType")}


READERS: dict[str, Callable] = {"CT": read_scan, "MR": read_scan, "PT": read_pet, "RTDOSE": read_dose}


def read_auto(headers: list[dict], modality: str | None = None, pet_image_type: PETImageType = PETImageType.SUV) -> tuple:
    """The modality's reader; without a modality that of the first header."""
    modality = modality or text_of(headers[0].get("Modality"))
    if modality not in READERS:
        raise ValueError(f"no image is read of modality {modality!r}")
    return read_pet(headers, pet_image_type) if modality == "PT" else READERS[modality](headers)


def load_series(instances: DataFrame, load_subseries: bool = False, pet_image_type: PETImageType = PETImageType.SUV) -> DataFrame:
    """One volume row (``IMAGE``) per series of instance rows, or per subseries.

    A task holds one series.  Files are opened by path inside the task, so no
    pixels are shuffled, unless the rows carry ``content``.  A series that can't
    be read is a row with ``error``; one whose slices don't make a regular grid
    says so in ``meta`` under ``geometry``, since its spacing is a mean.
    """
    held = "content" in instances.columns
    rows = instances.withColumn("_sub", sub_series() if load_subseries else F.lit("1"))
    rows = rows.select(F.col("SeriesInstanceUID").alias("series"), F.col("_sub").alias("sub_series"), "path", *(["content"] if held else []))

    def one(pdf: pd.DataFrame) -> tuple:
        series, sub = pdf["series"].iloc[0], pdf["sub_series"].iloc[0]
        pdf = pdf.sort_values("path")
        try:
            data = pdf["content"] if held else map(storage.read_bytes, pdf["path"])
            headers = [dicom.parse(x, pixels=True) for x in data]
            modality = text_of(headers[0].get("Modality"))
            a, spacing, origin, d, more = read_auto(headers, modality, pet_image_type)
            meta = {k: v for k, v in (dicom.project(headers[0]) | more | unevenness(headers)).items() if v}
            return series, sub, modality, list(a.shape[::-1]), spacing, origin, d, a.astype("<f4").tobytes(), meta, None
        except Exception as e:  # noqa: BLE001  a bad series is data here
            return series, sub, None, None, None, None, None, None, None, f"LoadError: {type(e).__name__}: {e}"

    return volumes.in_groups(rows, ["series", "sub_series"], one, IMAGE)


def encode_slices(rows: DataFrame, header: Callable[[dict], list[dict]]) -> DataFrame:
    """(path, SeriesInstanceUID, AcquisitionNumber, content): encoded files of each row, for fixtures and tests."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def files(b: pd.DataFrame) -> Iterator[tuple]:
            for r in b.itertuples(index=False):
                for i, h in enumerate(header(dict(zip(names, r, strict=True)))):
                    yield f"{h['SeriesInstanceUID']}/{i:04d}.dcm", h["SeriesInstanceUID"], h.get("AcquisitionNumber"), dicom.encode(h)

        for b in batches:
            yield from volumes.batched(files(b), ["path", "SeriesInstanceUID", "AcquisitionNumber", "content"])

    return rows.mapInPandas(run, "path string, SeriesInstanceUID string, AcquisitionNumber string, content binary")
