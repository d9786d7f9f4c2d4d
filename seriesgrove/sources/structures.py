"""Structure sets and segmentations to region rows, and region rows to masks on a reference grid.

A region row is (series, roi_pos, roi, description, number, kind, contours,
frames, error): closed contours in physical x, y, z for a structure set, frames
(position and packed bits) for a segmentation.  A region that can't be read
keeps its row with ``error`` set; a file that can't be read is one row with no
region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors as E
from .. import storage
from ..operators import volumes
from . import dicom
from .series import frames_of, number, numbers, text_of

REGION = (
    "series string, roi_pos int, roi string, description string, number int, kind string, contours array<array<double>>, "
    "frames array<struct<position:array<double>,rows:int,cols:int,bits:binary>>, error string"
)
NAMES = ["series", "roi_pos", "roi", "description", "number", "kind", "contours", "frames", "error"]
CLOSED = "CLOSED_PLANAR"


def contours_of(h: dict, at: int, roi: int | None = None) -> list[list[float]]:
    """The closed contours of the region of number ``roi``, or a ROIContourError.

    Items of the contour sequence name their region's number and may stand in
    any order; one that names none belongs to the region at its position.
    """
    every = h.get("ROIContourSequence")
    if every is None:
        raise E.ROIContourError("the file has no ROIContourSequence")
    named = [numbers(x.get("ReferencedROINumber")) for x in every]
    place = next((i for i, n in enumerate(named) if roi is not None and n == [roi]), at)
    if place >= len(every) or (named[place] and roi is not None and named[place] != [roi]):
        raise E.ROIContourError("no contours of this region")
    own = every[place].get("ContourSequence")
    if own is None:
        raise E.ROIContourError("no ContourSequence")
    if not own:
        raise E.ROIContourError("an empty ContourSequence")
    if "ContourData" not in own[0]:
        raise E.ROIContourError("no ContourData")
    kind = text_of(own[0].get("ContourGeometricType"))
    if kind != CLOSED:
        raise E.ROIContourError(f"contours are {kind}, not {CLOSED}")
    return [numbers(c.get("ContourData")) for c in own]


def structure_regions(h: dict) -> Iterator[tuple]:
    series = text_of(h.get("SeriesInstanceUID"))
    if "StructureSetROISequence" not in h:
        raise E.RTSTRUCTAttributeError("the file has no StructureSetROISequence")
    for i, roi in enumerate(h["StructureSetROISequence"]):
        name, own = text_of(roi.get("ROIName")), numbers(roi.get("ROINumber"))
        n = int(own[0]) if own else i
        try:
            yield series, i, name, None, n, "contours", contours_of(h, i, n if own else None), None, None
        except E.ROIContourError as e:
            yield series, i, name, None, n, "contours", None, None, f"ROIContourExtractionError: {e}"


def _inner(group: dict, sequence: str, field: str) -> list[float]:
    items = group.get(sequence) or [{}]
    return numbers(items[0].get(field))


def positions(h: dict, n: int) -> list[list[float]]:
    """The position of every frame: its own, or stepped from the shared geometry."""
    own = [_inner(g, "PlanePositionSequence", "ImagePositionPatient") for g in h.get("PerFrameFunctionalGroupsSequence") or []]
    if len(own) == n and all(len(p) == 3 for p in own):
        return own
    shared = (h.get("SharedFunctionalGroupsSequence") or [{}])[0]
    first = next((p for p in own if len(p) == 3), None) or _inner(shared, "PlanePositionSequence", "ImagePositionPatient") or numbers(h.get("ImagePositionPatient"))
    orientation = _inner(shared, "PlaneOrientationSequence", "ImageOrientationPatient")
    gap = _inner(shared, "PixelMeasuresSequence", "SpacingBetweenSlices") or _inner(shared, "PixelMeasuresSequence", "SliceThickness")
    if len(first) != 3 or len(orientation) != 6 or not gap:
        raise E.SegmentReferenceIndicesError("the frames have no positions and no shared geometry")
    normal = np.cross(orientation[:3], orientation[3:])
    return [(np.array(first) + k * gap[0] * normal).tolist() for k in range(n)]


def segment_regions(h: dict) -> Iterator[tuple]:
    series, kind = text_of(h.get("SeriesInstanceUID")), text_of(h.get("SegmentationType"))
    if not kind:
        raise E.SegmentationError("the file has no SegmentationType")
    if kind not in ("BINARY", "FRACTIONAL"):
        raise E.SegmentationTypeUnsupportedError(kind)
    segments = {}
    for s in h.get("SegmentSequence") or []:
        k = int(number(s.get("SegmentNumber"), 0))
        if k in segments:
            raise E.SegmentDuplicateError(f"segment {k} is there twice")
        segments[k] = (text_of(s.get("SegmentLabel")), text_of(s.get("SegmentDescription")) or None)
    if kind == "FRACTIONAL" and len(segments) != 1:
        raise E.SegmentationError(f"a fractional segmentation must have one segment, not {len(segments)}")
    a = frames_of(h)
    at = positions(h, len(a))
    if kind == "FRACTIONAL":
        of = [next(iter(segments))] * len(a)
    else:
        groups = h.get("PerFrameFunctionalGroupsSequence") or []
        of = [int(number((g.get("SegmentIdentificationSequence") or [{}])[0].get("ReferencedSegmentNumber"), 0)) for g in groups]
        if len(of) != len(a):
            raise E.SegmentationValidationError(f"{len(a)} frames but {len(of)} frame descriptions")
    for i, (k, (label, description)) in enumerate(segments.items()):
        mine = [j for j, x in enumerate(of) if x == k]
        frames = [{"position": at[j], "rows": a.shape[1], "cols": a.shape[2], "bits": np.packbits(a[j].ravel() > 0).tobytes()} for j in mine]
        error = None if mine else f"SegmentDataMissingError: segment {k} ({label}) has no frames"
        yield series, i, label, description, k, "frames", None, frames, error


def read_regions(files: DataFrame) -> DataFrame:
    """Region rows of (path, or path and content): one file is one structure set or segmentation."""
    held = "content" in files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each(b: pd.DataFrame) -> Iterator[tuple]:
            for r in b.itertuples(index=False):
                try:
                    h = dicom.parse(r.content if held else storage.read_bytes(r.path), pixels=True)
                    found = list((segment_regions if text_of(h.get("Modality")) == "SEG" else structure_regions)(h))
                except Exception as e:  # noqa: BLE001  a bad file is data here
                    found = [(r.series, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield from found

        def weigh(r: tuple) -> int:
            return sum(32 * len(c) for c in r[6] or ()) + sum(len(f["bits"]) for f in r[7] or ())  # contours and frames

        for b in batches:
            yield from volumes.batched(each(b), NAMES, weigh)

    series = [] if "SeriesInstanceUID" not in files.columns else ["SeriesInstanceUID"]
    rows = files.select("path", *(["content"] if held else []), (F.col(series[0]) if series else F.lit(None).cast("string")).alias("series"))
    return storage.spread(rows, "path").mapInPandas(run, REGION)


def region(regions: DataFrame, key: str | int | slice) -> DataFrame:
    """The regions of each series by name, position or slice of positions that can be read; a name or position that no series has is a MissingROIError."""
    good = regions.where("error is null")
    if isinstance(key, slice):
        low, high = key.start or 0, key.stop
        return good.where((F.col("roi_pos") >= low) & (F.col("roi_pos") < high if high is not None else F.lit(True)))
    if isinstance(key, bool) or not isinstance(key, str | int) or (isinstance(key, int) and key < 0):
        raise E.MissingROIError(f"a region is looked up by name, position from 0 or slice, not {key!r}")
    found = good.where(F.col("roi") == key if isinstance(key, str) else F.col("roi_pos") == key)
    if found.isEmpty():
        raise E.MissingROIError(f"no region {key!r}")
    return found


def identifiers(regions: DataFrame) -> DataFrame:
    """(series, roi, number): labels of readable regions; of several with one label the last counts."""
    return regions.where("error is null").groupBy("series", "roi").agg(F.max_by("number", "roi_pos").alias("number"))


MASK = "series string, channel int, roi_key string, roi_names array<string>, image_id string"


def masks(regions: DataFrame, matched: DataFrame, grids: DataFrame) -> DataFrame:
    """Mask volumes of matched regions on each series' reference grid.

    ``matched`` is what ``roi.match`` gives (series, key_pos, key, roi_names,
    image_id), ``grids`` has size, origin, spacing and direction per series.
    Channels count from 1 in the order of keys, names and ids.  Several regions
    of one key are joined by OR.  A key that can't be drawn is an error row.
    """
    last = identifiers(regions).select("series", "roi", "number")
    good = regions.where("error is null").join(last, ["series", "roi", "number"]).select("series", "roi", "contours", "frames")
    names = matched.select("series", "key_pos", F.col("key").alias("roi_key"), "image_id", "roi_names", F.explode(F.array_distinct("roi_names")).alias("roi"))
    held = names.join(good, ["series", "roi"]).groupBy("series", "key_pos", "roi_key", "image_id").agg(
        F.first("roi_names").alias("roi_names"), F.flatten(F.collect_list("contours")).alias("contours"), F.flatten(F.collect_list("frames")).alias("frames")
    )
    order = F.array_sort(F.collect_list(F.struct("key_pos", "image_id")))
    channels = held.groupBy("series").agg(order.alias("order"))
    held = held.join(channels, "series").withColumn("channel", F.array_position("order", F.struct("key_pos", "image_id")).cast("int")).drop("order", "key_pos")
    rows = held.join(grids.select("series", "size", "origin", "spacing", "direction"), "series")
    rows = rows.withColumn("voxels", F.lit(b"").cast("binary")).withColumn("error", F.lit(None).cast("string"))
    return volumes.map_rows(storage.spread(rows, "series", "channel"), draw, "MaskError").drop("contours", "frames")


def draw(r: dict) -> dict:
    """The mask of one row: contours filled, frames laid on the slice their position falls on (those outside the grid are left out)."""
    size, place = [int(n) for n in r["size"]], (r["origin"], r["spacing"], r["direction"])
    out = np.zeros(size[::-1], bool)
    if r["contours"] is not None and len(r["contours"]):
        index = [volumes.to_index(np.asarray(c, float).reshape(-1, 3), *place).ravel().tolist() for c in r["contours"]]
        out |= volumes.contour_mask(index, tuple(size))
    for f in r["frames"] if r["frames"] is not None else ():
        z = int(volumes.to_index(np.array([f["position"]], float), *place)[0, 2])
        if (f["rows"], f["cols"]) != (size[1], size[0]):
            raise E.SegmentationValidationError(f"frames of {f['rows']} x {f['cols']} on a grid of {size[1]} x {size[0]}")
        if 0 <= z < size[2]:
            out[z] |= np.unpackbits(np.frombuffer(f["bits"], np.uint8), count=f["rows"] * f["cols"]).reshape(f["rows"], f["cols"]).astype(bool)
    return {"voxels": out.astype("<f4").tobytes()}


def to_voxels(masks_: DataFrame) -> DataFrame:
    """Sparse rows (series, channel, z, y, x) of mask volumes, as the mask operators take them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(held: list[tuple[str, int, np.ndarray]]) -> pd.DataFrame:
            n, at = [len(a) for _, _, a in held], np.concatenate([a for _, _, a in held])
            series, channel = (np.repeat(np.array([r[i] for r in held], kind), n) for i, kind in ((0, object), (1, np.int32)))
            return pd.DataFrame({"series": series, "channel": channel, "z": at[:, 0], "y": at[:, 1], "x": at[:, 2]})

        for b in batches:
            held, count = [], 0
            for r in b.itertuples(index=False):
                at = np.argwhere(volumes.array_of(r.voxels, r.size))
                for i in range(0, len(at), 1 << 18):
                    held.append((r.series, r.channel, at[i : i + (1 << 18)]))
                    count += len(held[-1][2])
                    if count > volumes.BATCH_VOXELS:
                        yield told(held)
                        held, count = [], 0
            if held:
                yield told(held)

    return masks_.where("error is null").select("series", "channel", "size", "voxels").mapInPandas(run, "series string, channel int, z long, y long, x long")


def encode_mask(masks_: DataFrame, keys: list[str], how: str = "label") -> DataFrame:
    """One volume per series of its mask channels: ``label`` (an overlap is an error row), ``sparse`` (the highest channel wins) or ``region`` (a bit per channel).

    Label values follow ``keys``.  A series that lacks one of them is an error row.
    """
    if how == "region" and len(keys) > 32:
        raise E.TooManyComponentsError("a region mask holds at most 32 channels")
    if how not in ("label", "sparse", "region"):
        raise ValueError(f"unknown mask strategy {how!r}")
    group = ["series"] if "sample_number" not in masks_.columns else ["sample_number", "series"]
    kinds = {f.name: f.dataType.simpleString() for f in masks_.schema}
    out_kind = ", ".join(f"{c} {kinds[c]}" for c in group) + ", size array<int>, spacing array<double>, origin array<double>, direction array<double>, voxels binary, roi_names map<string,string>, error string"

    def one(pdf: pd.DataFrame) -> tuple:
        first = pdf.iloc[0]
        good = {r.roi_key: r for r in pdf.itertuples() if not isinstance(r.error, str)}
        base = [first[c] for c in group]
        names = {k: "|".join(r.roi_names) for k, r in good.items()}
        missing = [k for k in keys if k not in good]
        if missing:
            return (*base, None, None, None, None, None, names, f"MissingROIsError: no {', '.join(missing)}")
        r = good[keys[0]]
        out, seen = np.zeros(tuple(r.size)[::-1], np.int64), np.zeros(tuple(r.size)[::-1], bool)
        for i, k in enumerate(keys):
            m = volumes.array_of(good[k].voxels, good[k].size) > 0
            if how == "label" and (m & seen).any():
                return (*base, None, None, None, None, None, names, "OverlappingMasksError: a label image cannot hold overlapping masks")
            out, seen = (out | (m.astype(np.int64) << i) if how == "region" else np.where(m, i + 1, out)), seen | m
        return (*base, list(r.size), list(r.spacing), list(r.origin), list(r.direction), out.astype("<f4").tobytes(), names, None)

    wanted = masks_.select(*group, "roi_key", "roi_names", "size", "spacing", "origin", "direction", "voxels", "error")
    return volumes.in_groups(wanted, group, one, out_kind)
