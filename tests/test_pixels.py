"""Encapsulated pixels, byte orders and regular grids."""

import numpy as np
import pytest
from seriesgrove.errors import InvalidDicomError
from seriesgrove.sources import dicom, pixels, series, structures

RNG = np.random.default_rng(6)
FRAMES = [
    RNG.integers(0, 65536, (7, 9)).astype("<u2"),
    (np.indices((40, 33)).sum(axis=0) * 3).astype("<u2"),
    np.zeros((5, 6), "<u2"),
    np.full((1, 1), 65535, "<u2"),
    RNG.integers(0, 2, (1, 300)).astype("<u2") * 65535,
    np.repeat(RNG.integers(0, 9, 40), RNG.integers(1, 300, 40))[:3000].astype("<u2").reshape(-1, 10)[:, :10],
]


@pytest.mark.parametrize("a", FRAMES)
def test_frames_come_back(a):
    assert (pixels.decode_runs(pixels.encode_runs(a), *a.shape, 2) == a).all()
    for kind in range(1, 8):
        assert (pixels.decode_lossless(pixels.encode_lossless(a, kind)) == a).all()
    b = (a & 255).astype("u1")
    assert (pixels.decode_runs(pixels.encode_runs(b), *b.shape, 1) == b).all()


def test_run_lengths_of_the_standard():
    assert pixels.unpacked(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x80, 0x03, 1, 2, 3, 4]), 14) == b"\xaa\xaa\xaa\x80\x00*\xaa\xaa\xaa\xaa\x01\x02\x03\x04"
    with pytest.raises(InvalidDicomError):
        pixels.unpacked(b"\x00\x01", 2)


def test_fragments_to_frames():
    parts = [b"ab", b"cd", b"efgh", b"ij"]
    table = np.array([0, 20], "<u4").tobytes()  # the second frame begins at the third fragment
    assert pixels.frames([table, *parts], 2) == [b"abcd", b"efghij"]
    assert pixels.frames([b"", *parts], 4) == parts
    assert pixels.frames([b"", *parts], 1) == [b"abcdefghij"]
    assert pixels.frames([b"", *parts], 2, np.array([0, 20], "<u8").tobytes()) == [b"abcd", b"efghij"]
    for bad in ([b"", *parts], [np.array([0, 5], "<u4").tobytes(), *parts]):
        with pytest.raises(InvalidDicomError):
            pixels.frames(bad, 2)


def header(a, syntax, data, **more):
    return {"SOPInstanceUID": "1.1", "SeriesInstanceUID": "1", "Modality": "CT", "Rows": a.shape[-2], "Columns": a.shape[-1], "BitsAllocated": 16, "PixelRepresentation": 0, "SamplesPerPixel": 1, "TransferSyntaxUID": syntax, "PixelData": data} | more


@pytest.mark.parametrize("syntax", [pixels.IMPLICIT, pixels.EXPLICIT, pixels.DEFLATED, pixels.BIG, pixels.RUN_LENGTH, pixels.LOSSLESS, pixels.LOSSLESS_FIRST])
def test_files_of_every_syntax(syntax):
    a = FRAMES[0]
    data = {pixels.BIG: a.astype(">u2").tobytes(), pixels.RUN_LENGTH: pixels.encapsulated([pixels.encode_runs(a)])}.get(syntax, pixels.encapsulated([pixels.encode_lossless(a)]) if ".4." in syntax[17:] else a.tobytes())
    raw = dicom.encode(header(a, syntax, data, ImagePositionPatient=["1", "2", "3"], ReferencedSeriesSequence=[{"SeriesInstanceUID": "9.9"}]))
    h = dicom.parse(raw, pixels=True)
    assert h["Rows"] == 7 and h["ReferencedSeriesSequence"][0]["SeriesInstanceUID"] == "9.9" and h["ImagePositionPatient"] == ["1", "2", "3"]
    assert (series.frames_of(h) == a[None]).all()
    assert "PixelData" not in dicom.parse(raw)


def test_several_frames_and_signs():
    a = RNG.integers(-2000, 2000, (3, 6, 5)).astype("<i2")
    for syntax, encode in ((pixels.RUN_LENGTH, pixels.encode_runs), (pixels.LOSSLESS, pixels.encode_lossless)):
        h = dicom.parse(dicom.encode(header(a, syntax, pixels.encapsulated([encode(x.view("<u2")) for x in a]), NumberOfFrames="3", PixelRepresentation=1)), pixels=True)
        assert (series.frames_of(h) == a).all()


def test_damaged_and_unknown_files():
    a = FRAMES[0]
    jpeg = pixels.encode_lossless(a)
    for syntax, data in (("1.2.840.10008.1.2.4.90", [b"", b"xx"]), (pixels.RUN_LENGTH, [b"", b"short"]), (pixels.LOSSLESS, [b"", b"\xff\xd8"]), (pixels.LOSSLESS, [b"", jpeg.replace(b"\xff\xc3", b"\xff\xc0")]), (pixels.RUN_LENGTH, [])):
        h = dicom.parse(dicom.encode(header(a, syntax, data)), pixels=True)
        with pytest.raises(InvalidDicomError):
            series.frames_of(h)


def test_uneven_series():
    at = lambda *zs: [{"ImagePositionPatient": ["0", "0", str(z)], "ImageOrientationPatient": ["1", "0", "0", "0", "1", "0"]} for z in zs]
    assert series.unevenness(at(0, 2, 4, 6)) == series.unevenness(at(5)) == series.unevenness([{}, {}]) == series.unevenness(at(6, 2.001, 4, 0)) == {}
    assert series.unevenness(at(0, 2, 6, 8)) == {"geometry": "steps between slices from 2 to 4"}
    assert series.unevenness(at(0, 2, 2, 4)) == {"geometry": "1 slices stand at another's place"}
    turned = at(0, 2)
    turned[1]["ImageOrientationPatient"] = ["0", "1", "0", "1", "0", "0"]
    assert series.unevenness(turned) == {"geometry": "the slices' orientations differ"}


def test_contours_by_number():
    square = lambda x: [{"ContourGeometricType": "CLOSED_PLANAR", "ContourData": [str(x), "0", "0", "1", "0", "0", "1", "1", "0"]}]
    h = {"SeriesInstanceUID": "1", "StructureSetROISequence": [{"ROINumber": str(n), "ROIName": f"r{n}"} for n in (3, 1, 2)]}
    named = [{"ReferencedROINumber": "1", "ContourSequence": square(1)}, {"ReferencedROINumber": "3", "ContourSequence": square(3)}]
    got = {r[2]: (r[6][0][0] if r[6] else None, r[8]) for r in structures.structure_regions(h | {"ROIContourSequence": named})}
    assert got["r3"] == (3.0, None) and got["r1"] == (1.0, None) and got["r2"][0] is None and got["r2"][1].startswith("ROIContourExtractionError")
    plain = [{"ContourSequence": square(k)} for k in (5, 6, 7)]
    assert [r[6][0][0] for r in structures.structure_regions(h | {"ROIContourSequence": plain})] == [5.0, 6.0, 7.0]
