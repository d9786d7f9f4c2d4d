"""DICOM headers to rows: a tag walker over bytes, and an encoder for fixtures.

The walker reads explicit and implicit, big-endian and deflated data sets, nested
and undefined-length sequences, fragments of encapsulated pixels, and stops
before the pixel data where only the header is asked for.  A file that
cannot be read becomes a row with ``error`` set.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..errors import InvalidDicomError
from ..operators.volumes import batched
from .dicom_tags import BASE, BY_MODALITY, COMPUTED, NAMES, TAGS
from .files import find_dicoms
from .pixels import BIG, DEFLATED, EXPLICIT, IMPLICIT

LONG = frozenset(("OB", "OW", "OF", "OD", "OL", "OV", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"))
UNDEFINED = 0xFFFFFFFF
STOPPED = -1  # where the walk ends when it meets the pixels
ITEM, ITEM_END, SEQUENCE_END = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
PIXELS = TAGS["PixelData"][0]
HEAD = 1 << 17  # bytes of a file that are read for its header at first
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d"}


def _value(vr: str, raw: bytes, order: str = "<"):  # noqa: ANN202
    if vr in NUMBERS:
        kind = struct.Struct(order + NUMBERS[vr])
        got = [kind.unpack_from(raw, i)[0] for i in range(0, len(raw) - kind.size + 1, kind.size)]
        return got[0] if len(got) == 1 else got
    if vr in LONG:
        return raw
    parts = [p.strip(" \x00") for p in raw.decode("utf-8", "replace").split("\\")]
    return parts[0] if len(parts) == 1 else parts


def _walk(data: bytes, at: int, end: int, explicit: bool, pixels: bool, order: str = "<") -> tuple[dict, int]:
    out: dict = {}
    while at + 8 <= end:
        group, element = struct.unpack_from(order + "HH", data, at)
        tag = group << 16 | element
        if tag in (ITEM_END, SEQUENCE_END):
            return out, at + 8
        if tag == PIXELS and not pixels:
            return out, STOPPED
        if explicit and group != 0xFFFE:
            vr = data[at + 4 : at + 6].decode("ascii", "replace")
            if vr in LONG:
                length, at = struct.unpack_from(order + "I", data, at + 8)[0], at + 12
            else:
                length, at = struct.unpack_from(order + "H", data, at + 6)[0], at + 8
        else:
            vr = TAGS[NAMES[tag]][1] if tag in NAMES else "UN"
            length, at = struct.unpack_from(order + "I", data, at + 4)[0], at + 8
        name = NAMES.get(tag, f"{tag:08X}")
        if tag == PIXELS and length == UNDEFINED:
            out[name], at = _fragments(data, at, end)
            continue
        if vr == "SQ" or length == UNDEFINED:
            out[name], at = _sequence(data, at, end if length == UNDEFINED else at + length, explicit, length == UNDEFINED, order)
            continue
        if at + length > end:
            raise InvalidDicomError(f"{name} runs past the end")
        out[name] = _value(vr, data[at : at + length], order)
        at += length
    return out, at


def _fragments(data: bytes, at: int, end: int) -> tuple[list[bytes], int]:
    """The offset table and the fragments of encapsulated pixels."""
    parts = []
    while at + 8 <= end:
        group, element, length = struct.unpack_from("<HHI", data, at)
        at += 8
        if group << 16 | element == SEQUENCE_END:
            break
        if group << 16 | element != ITEM or at + length > end:
            raise InvalidDicomError("a fragment of the pixels runs past the end")
        parts.append(data[at : at + length])
        at += length
    return parts, at


def _sequence(data: bytes, at: int, end: int, explicit: bool, open_: bool, order: str = "<") -> tuple[list[dict], int]:
    items = []
    while at + 8 <= end:
        tag = struct.unpack_from(order + "HH", data, at)
        length = struct.unpack_from(order + "I", data, at + 4)[0]
        at += 8
        if tag[0] << 16 | tag[1] == SEQUENCE_END:
            break
        stop = end if length == UNDEFINED else at + length
        item, after = _walk(data, at, stop, explicit, True, order)
        items.append(item)
        at = after if length == UNDEFINED else stop
    return items, at if open_ else end


def parse(data: bytes, pixels: bool = False, complete: bool = True) -> dict | None:
    """Keyword to value: text, list of texts, number, or list of items.

    Without ``complete`` the data is the start of a file: None if the header may
    go on beyond it.
    """
    if not isinstance(data, bytes | bytearray | memoryview):
        raise InvalidDicomError(f"cannot read {type(data).__name__}")
    data = bytes(data)
    meta, at, explicit, order = {}, 0, True, "<"
    if data[128:132] == b"DICM":
        at, size = 132, len(data)
        while at + 8 <= size and struct.unpack_from("<H", data, at)[0] == 2:
            vr = data[at + 4 : at + 6].decode("ascii", "replace")
            head = 12 if vr in LONG else 8
            length = struct.unpack_from("<I" if vr in LONG else "<H", data, at + (8 if vr in LONG else 6))[0]
            tag = 2 << 16 | struct.unpack_from("<H", data, at + 2)[0]
            meta[NAMES.get(tag, f"{tag:08X}")] = _value(vr, data[at + head : at + head + length])
            at += head + length
        syntax = meta.get("TransferSyntaxUID", "")
        explicit, order = syntax != IMPLICIT, ">" if syntax == BIG else "<"
        if syntax == DEFLATED:
            data, at = zlib.decompressobj(-zlib.MAX_WBITS).decompress(data[at:]), 0  # of a cut file, as far as it goes
    elif data[4:6].isalpha() is False:
        explicit = False
    body, stop = _walk(data, at, len(data), explicit, pixels, order)
    if not complete and stop != STOPPED:
        return None
    if not body:
        raise InvalidDicomError("no data elements")
    return meta | body


def encode(values: dict, explicit: bool = True, preamble: bool = True) -> bytes:
    """The inverse of parse for text, numbers, bytes, sequences and fragments.

    A ``TransferSyntaxUID`` among the values decides the form; pixel bytes are
    taken as they are.
    """
    syntax = values.get("TransferSyntaxUID", EXPLICIT if explicit else IMPLICIT)
    explicit = explicit and syntax != IMPLICIT

    def one(name: str, v, order: str) -> bytes:  # noqa: ANN001
        tag, vr = TAGS[name]
        size = None
        if vr == "SQ":
            raw = b"".join(struct.pack(order + "HHI", 0xFFFE, 0xE000, len(b)) + b for b in (body(i, order) for i in v))
        elif tag == PIXELS and isinstance(v, list):
            raw = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(f)) + f for f in v) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
            size = UNDEFINED
        elif vr in NUMBERS:
            raw = b"".join(struct.pack(order + NUMBERS[vr], x) for x in (v if isinstance(v, list) else [v]))
        elif isinstance(v, bytes):
            raw = v + b"\x00" * (len(v) % 2)
        else:
            raw = ("\\".join(map(str, v)) if isinstance(v, list) else str(v)).encode()
            raw += (b"\x00" if vr == "UI" else b" ") * (len(raw) % 2)
        size = len(raw) if size is None else size
        head = struct.pack(order + "HH", tag >> 16, tag & 0xFFFF)
        if not explicit and tag >> 16 != 2:
            return head + struct.pack("<I", size) + raw
        return head + vr.encode() + (b"\x00\x00" + struct.pack(order + "I", size) if vr in LONG else struct.pack(order + "H", size)) + raw

    def body(vs: dict, order: str) -> bytes:
        return b"".join(one(k, vs[k], order) for k in sorted(vs, key=lambda k: TAGS[k][0]))

    data = body({k: v for k, v in values.items() if k != "TransferSyntaxUID"}, ">" if syntax == BIG else "<")
    if syntax == DEFLATED:
        packer = zlib.compressobj(9, zlib.DEFLATED, -zlib.MAX_WBITS)
        data = packer.compress(data) + packer.flush()
    return (b"\x00" * 128 + b"DICM" + one("TransferSyntaxUID", syntax, "<") if preamble else b"") + data


# --- references ---------------------------------------------------------------


def _first(seq: object) -> dict:
    return seq[0] if isinstance(seq, list) and seq and isinstance(seq[0], dict) else {}


def references(h: dict) -> tuple[str, list[str], list[str]]:
    """Referenced series, referenced SOPs and region names of a header."""
    kind, sops = h.get("Modality"), []
    if kind == "RTSTRUCT":
        series = _first(_first(_first(h.get("ReferencedFrameOfReferenceSequence")).get("RTReferencedStudySequence")).get("RTReferencedSeriesSequence"))
        sops = [x.get("ReferencedSOPInstanceUID", "") for x in series.get("ContourImageSequence") or []]
        names = [x.get("ROIName", "") for x in h.get("StructureSetROISequence") or []]
        return series.get("SeriesInstanceUID", ""), sops, names
    if kind == "SEG":
        refs = h.get("ReferencedSeriesSequence") or []
        names = [x.get("SegmentLabel", "") for x in h.get("SegmentSequence") or []]
        if len(refs) == 1:
            return refs[0].get("SeriesInstanceUID", ""), [x.get("ReferencedSOPInstanceUID", "") for x in refs[0].get("ReferencedInstanceSequence") or []], names
        return "", [x.get("ReferencedSOPInstanceUID", "") for x in h.get("SourceImageSequence") or []], names
    if kind == "RTDOSE":
        keys = ("ReferencedRTPlanSequence", "ReferencedStructureSetSequence")
        sops = [s for s in (_first(h.get(k)).get("ReferencedSOPInstanceUID") for k in keys) if s]
        return _first(h.get("ReferencedImageSequence")).get("ReferencedSOPInstanceUID", ""), sops, []
    if kind == "RTPLAN":
        return "", [x.get("ReferencedSOPInstanceUID", "") for x in h.get("ReferencedStructureSetSequence") or []], []
    if kind == "SR":
        series = [s for e in h.get("CurrentRequestedProcedureEvidenceSequence") or [] for s in e.get("ReferencedSeriesSequence") or []]
        uids = sorted({s["SeriesInstanceUID"] for s in series if s.get("SeriesInstanceUID")})
        return ";".join(uids), sorted({x.get("ReferencedSOPInstanceUID", "") for s in series for x in s.get("ReferencedSOPSequence") or []}), []
    return "", [], []


def dose_references(h: dict) -> tuple[str, str, str]:
    """The first referenced plan, structure set and series of a dose, empty if there is none."""
    of = lambda k: text(_first(h.get(k)).get("ReferencedSOPInstanceUID"))
    return of("ReferencedRTPlanSequence"), of("ReferencedStructureSetSequence"), of("ReferencedImageSequence")


def plan_reference(h: dict) -> str:
    """The first structure set that a plan refers to."""
    return text(_first(h.get("ReferencedStructureSetSequence")).get("ReferencedSOPInstanceUID"))


def _shared(h: dict, sequence: str) -> dict:
    return _first(_first(h.get("SharedFunctionalGroupsSequence")).get(sequence))


def segment_spacing(h: dict) -> list[float] | str:
    m = _shared(h, "PixelMeasuresSequence")
    gap = m.get("SpacingBetweenSlices") or m.get("SliceThickness")
    return [*map(float, m["PixelSpacing"][:2]), float(gap)] if isinstance(m.get("PixelSpacing"), list) and gap else ""


def segment_direction(h: dict) -> list[float] | str:
    d = _shared(h, "PlaneOrientationSequence").get("ImageOrientationPatient")
    return [float(x) for x in d] if isinstance(d, list) else ""


COMPUTED |= {
    "SEG": {
        "SegSpacing": segment_spacing, "SegDirection": segment_direction, "ROINames": lambda h: references(h)[2],
        "ROIDescriptions": lambda h: [x.get("SegmentDescription", "") for x in h.get("SegmentSequence") or []],
        "ReferencedSeriesUID": lambda h: references(h)[0], "ReferencedSOPUIDs": lambda h: references(h)[1],
    },
    "RTSTRUCT": {
        "ReferencedSeriesUID": lambda h: references(h)[0], "ReferencedSOPUIDs": lambda h: references(h)[1], "ROINames": lambda h: references(h)[2], "NumROIs": lambda h: len(references(h)[2]),
    },
    "RTDOSE": {"ReferencedSeriesUID": lambda h: dose_references(h)[2], "ReferencedSeriesSOPUIDs": lambda h: [x for x in dose_references(h)[:2] if x]},
    "RTPLAN": {"ReferencedSOPUIDs": lambda h: [x for x in [plan_reference(h)] if x]},
    "SR": {"ReferencedSeriesUID": lambda h: [x for x in references(h)[0].split(";") if x], "ReferencedSOPUIDs": lambda h: references(h)[1]},
}


def text(v: object) -> str:
    return "" if v is None else f"[{', '.join(map(str, v))}]" if isinstance(v, list) else str(v)


def project(h: dict, extra: tuple[str, ...] = ()) -> dict[str, str]:
    """The modality's header and computed fields as text, missing ones and those that can't be computed empty, in sorted order."""
    if "Modality" not in h:
        raise ValueError("the header has no Modality")
    kind = text(h["Modality"]).upper()
    out = {k: text(h.get(k)) for k in {*BASE, *BY_MODALITY.get(kind, ()), *extra}}
    for k, f in COMPUTED.get(kind, {}).items():
        try:
            out[k] = text(f(h))
        except Exception:  # noqa: BLE001  a field that can't be computed is empty
            out[k] = ""
    return dict(sorted(out.items()))


def name_of(tag: str) -> str:
    """The name a parsed header has for a tag of eight hex digits."""
    return NAMES.get(int(tag, 16), tag.upper())


COLUMNS = ("PatientID", "StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID", "Modality", "AcquisitionNumber", "FrameOfReferenceUID")
ROWS = (
    "path string, " + ", ".join(f"{c} string" for c in COLUMNS) + ", ReferencedSeriesUID string, ReferencedSOPUIDs array<string>, ROINames array<string>, hdr map<string,string>, error string"
)


def parse_rows(files: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Instance rows of (path, content), or of (path) alone, whose heads are then read; unreadable files keep their path and an error.

    ``extra`` names header fields besides the modality's.
    """
    held = "content" in files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each(b: pd.DataFrame) -> Iterator[tuple]:
            for path, content in zip(b["path"], b["content"] if held else [None] * len(b), strict=True):
                try:
                    h = parse(content) if held else read_header(path)
                    ref, sops, rois = references(h)
                    yield path, *(text(h.get(c)) for c in COLUMNS), ref, sops, rois, project(h, ("SOPInstanceUID", *extra)), None
                except Exception as e:  # noqa: BLE001  a bad file is data here
                    yield path, *[None] * len(COLUMNS), None, None, None, None, f"{type(e).__name__}: {e}"

        for b in batches:
            yield from batched(each(b), ["path", *COLUMNS, "ReferencedSeriesUID", "ReferencedSOPUIDs", "ROINames", "hdr", "error"])

    return files.select("path", *(["content"] if held else [])).mapInPandas(run, ROWS)


def read_header(path: str, head: int = HEAD) -> dict:
    """The header of a file, read from its first ``head`` bytes, and from more only if it doesn't end there."""
    data = storage.read_bytes(path, head)
    while True:
        whole = len(data) < head
        try:
            found = parse(data, complete=whole)
        except InvalidDicomError:
            if whole:
                raise
            found = None
        if found is not None:
            return found
        head *= 8
        data = storage.read_bytes(path, head)


def encode_rows(rows: DataFrame, header: Callable[[Row], dict]) -> DataFrame:
    """(path, content) of one encoded header per row."""
    kind = Row(*rows.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from batched(((f"{r[0]}.dcm", encode(header(kind(*r)))) for r in b.itertuples(index=False, name=None)), ["path", "content"])

    return rows.mapInPandas(run, "path string, content binary")


def read_tags(instances: DataFrame, tags: list[str], truncate: int = 5, default: str = "") -> DataFrame:
    """path and the asked header fields; UIDs keep their last ``truncate`` characters."""
    from ..functions.strings import truncate_uid

    pick = lambda t: F.coalesce(F.nullif(F.element_at("hdr", F.lit(t)), F.lit("")), F.lit(default))
    return instances.select("path", *[(truncate_uid(pick(t), truncate) if t.endswith("UID") else pick(t)).alias(t) for t in tags])


def crawl(spark: SparkSession, directory: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Instance rows of all DICOM files below a directory; of the files only their heads are read."""
    return parse_rows(find_dicoms(spark, directory).select("path"), extra)
