"""Schemas of the engine's tables."""

INDEX = (
    "PatientID string, StudyInstanceUID string, SeriesInstanceUID string, SubSeries string, Modality string, "
    "ReferencedModality string, ReferencedSeriesUID string, instances int, folder string"
)
INSTANCE = (
    "path string, PatientID string, StudyInstanceUID string, SeriesInstanceUID string, SOPInstanceUID string, Modality string, "
    "AcquisitionNumber string, FrameOfReferenceUID string, ReferencedSeriesUID string, ReferencedSOPUIDs array<string>"
)
INSTANCE_KEYS = [c.split()[0] for c in INSTANCE.split(", ")]
INDEX_KEYS = [c.split()[0] for c in INDEX.split(", ")]
#: Index columns that decide whether two rows are duplicates.
DUPLICATE_KEYS = [c for c in INDEX_KEYS if c != "SubSeries"]
IMAGING = ("CT", "MR", "PT")
#: Query modalities in their canonical order.
MODALITIES = ("CT", "MR", "PT", "SEG", "RTSTRUCT", "RTDOSE")
