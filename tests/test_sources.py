import numpy as np
import pytest
from pyspark.sql import functions as F
from seriesgrove.errors import InvalidDicomError, InvalidDICOMKeyError
from seriesgrove.operators import volumes
from seriesgrove.plans import pipeline
from seriesgrove.sources import dicom, dicom_tags, files, nifti
from seriesgrove.streaming import incremental

CT = {"PatientID": "P1", "StudyInstanceUID": "1.1", "SeriesInstanceUID": "1.2", "SOPInstanceUID": "1.3", "Modality": "CT", "AcquisitionNumber": "1", "FrameOfReferenceUID": "1.9", "Rows": 4, "PixelData": b"\x01\x02"}
RT = {
    "PatientID": "P1", "StudyInstanceUID": "1.1", "SeriesInstanceUID": "2.2", "SOPInstanceUID": "2.3", "Modality": "RTSTRUCT",
    "StructureSetROISequence": [{"ROINumber": "1", "ROIName": "GTV"}, {"ROINumber": "2", "ROIName": "CTV"}],
    "ReferencedFrameOfReferenceSequence": [{"RTReferencedStudySequence": [{"RTReferencedSeriesSequence": [{"SeriesInstanceUID": "1.2", "ContourImageSequence": [{"ReferencedSOPInstanceUID": "1.3"}]}]}]}],
}


@pytest.mark.parametrize("explicit", [True, False])
@pytest.mark.parametrize("preamble", [True, False])
def test_header_roundtrip(explicit, preamble):
    h = dicom.parse(dicom.encode(RT, explicit, preamble))
    assert {k: h[k] for k in RT} == RT
    assert dicom.references(h) == ("1.2", ["1.3"], ["GTV", "CTV"])
    assert "PixelData" not in dicom.parse(dicom.encode(CT, explicit))
    with pytest.raises(InvalidDicomError):
        dicom.parse(dicom.encode(CT)[:-25])


def test_projection():
    p = dicom.project(dicom.parse(dicom.encode(CT)), ("Rows",))
    assert list(p) == sorted([*dicom_tags.keys_of("ct"), "Rows"]) and p["Rows"] == "4" and p["KVP"] == ""
    assert dicom.project(dicom.parse(dicom.encode(RT)))["NumROIs"] == "2" and "NumROIs" in dicom_tags.keys_of("RTSTRUCT")
    assert dicom_tags.lookup_tag("PatientID") == "00100020" and dicom_tags.similar_tags("PatientsID")[0] == "PatientID"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/1.dcm").write_bytes(dicom.encode(CT))
    (tmp_path / "in/a/2.DCM").write_bytes(dicom.encode(RT))
    (tmp_path / "in/a/bad.dcm").write_bytes(b"nothing")
    (tmp_path / "in/note.txt").write_text("x")
    return tmp_path


def test_find_crawl_and_sort(spark, folder):
    assert files.find_dicoms(spark, str(folder / "in")).count() == 3
    assert files.find_dicoms(spark, str(folder / "in"), check_header=True).count() == 2
    assert files.find_dicoms(spark, str(folder / "in"), search_input=["in", "2.DCM"]).count() == 1
    c = pipeline.Crawler(spark, str(folder / "in"), str(folder / "out"))
    index = {r.SeriesInstanceUID: r for r in c.index().collect()}
    assert index["2.2"].ReferencedModality == "CT" and c.instances().where("error is not null").count() == 1
    s = pipeline.samples(c.index(), "CT,RTSTRUCT").collect()
    assert [(r.sample_number, r.root) for r in s] == [("0000", "1.2")]
    with pytest.raises(pipeline.NoValidSamplesError):
        pipeline.samples(c.index(), "MR,SEG")
    plan = pipeline.plan_sort(c.instances().where("error is null"), "%PatientID/%Modality/{SeriesInstanceUID}")
    assert {r.target for r in plan.collect()} == {"P1/CT/1.2/1.dcm", "P1/RTSTRUCT/2.2/2.DCM"}
    with pytest.raises(InvalidDICOMKeyError):
        pipeline.plan_sort(c.instances(), "%PatientsID")


def test_stream_equals_batch(spark, folder):
    args = (str(folder / "in"), str(folder / "rows"), str(folder / "ck"))
    incremental.start(spark, *args).awaitTermination()
    (folder / "in/a/3.dcm").write_bytes(dicom.encode(CT | {"SOPInstanceUID": "1.4"}))
    incremental.start(spark, *args).awaitTermination()
    got = {r.SeriesInstanceUID: r.instances for r in incremental.index(spark, str(folder / "rows")).collect()}
    assert got == {"1.2": 2, "2.2": 1}


def test_nifti():
    a = np.arange(24, dtype=np.int16).reshape(2, 3, 4)
    b, spacing, origin = nifti.decode(nifti.encode(a, (1, 2, 3), (5, 6, 7)))
    assert (a == b).all() and spacing == (1, 2, 3) and origin == (5, 6, 7)
