"""The header fields the engine reads: keyword, tag, value representation."""

from __future__ import annotations

import difflib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import ExistingExtractorError

#: Fixed values from the DICOM data dictionary.
TAGS: dict[str, tuple[int, str]] = {
    "TransferSyntaxUID": (0x00020010, "UI"), "SpecificCharacterSet": (0x00080005, "CS"), "ImageType": (0x00080008, "CS"), "SOPClassUID": (0x00080016, "UI"),
    "SOPInstanceUID": (0x00080018, "UI"), "StudyDate": (0x00080020, "DA"), "SeriesDate": (0x00080021, "DA"), "AcquisitionDate": (0x00080022, "DA"), "ContentDate": (0x00080023, "DA"),
    "StudyTime": (0x00080030, "TM"), "SeriesTime": (0x00080031, "TM"), "AcquisitionTime": (0x00080032, "TM"), "ContentTime": (0x00080033, "TM"), "AccessionNumber": (0x00080050, "SH"),
    "Modality": (0x00080060, "CS"), "Manufacturer": (0x00080070, "LO"), "InstitutionName": (0x00080080, "LO"), "StudyDescription": (0x00081030, "LO"), "SeriesDescription": (0x0008103E, "LO"),
    "ManufacturerModelName": (0x00081090, "LO"), "ReferencedStudySequence": (0x00081110, "SQ"), "ReferencedSeriesSequence": (0x00081115, "SQ"), "ReferencedImageSequence": (0x00081140, "SQ"),
    "ReferencedSOPClassUID": (0x00081150, "UI"), "ReferencedSOPInstanceUID": (0x00081155, "UI"), "SourceImageSequence": (0x00082112, "SQ"), "ReferencedInstanceSequence": (0x0008114A, "SQ"),
    "PatientName": (0x00100010, "PN"), "PatientID": (0x00100020, "LO"), "PatientBirthDate": (0x00100030, "DA"), "PatientSex": (0x00100040, "CS"), "PatientAge": (0x00101010, "AS"),
    "PatientWeight": (0x00101030, "DS"), "BodyPartExamined": (0x00180015, "CS"), "SliceThickness": (0x00180050, "DS"), "KVP": (0x00180060, "DS"), "RepetitionTime": (0x00180080, "DS"),
    "EchoTime": (0x00180081, "DS"), "InversionTime": (0x00180082, "DS"), "MagneticFieldStrength": (0x00180087, "DS"), "SpacingBetweenSlices": (0x00180088, "DS"), "SoftwareVersions": (0x00181020, "LO"),
    "ProtocolName": (0x00181030, "LO"), "ExposureTime": (0x00181150, "IS"), "XRayTubeCurrent": (0x00181151, "IS"), "Exposure": (0x00181152, "IS"), "ConvolutionKernel": (0x00181210, "SH"),
    "FlipAngle": (0x00181314, "DS"), "PatientPosition": (0x00185100, "CS"), "StudyInstanceUID": (0x0020000D, "UI"), "SeriesInstanceUID": (0x0020000E, "UI"), "StudyID": (0x00200010, "SH"),
    "SeriesNumber": (0x00200011, "IS"), "AcquisitionNumber": (0x00200012, "IS"), "InstanceNumber": (0x00200013, "IS"), "ImagePositionPatient": (0x00200032, "DS"),
    "ImageOrientationPatient": (0x00200037, "DS"), "FrameOfReferenceUID": (0x00200052, "UI"), "SliceLocation": (0x00201041, "DS"), "SamplesPerPixel": (0x00280002, "US"),
    "PhotometricInterpretation": (0x00280004, "CS"), "NumberOfFrames": (0x00280008, "IS"), "Rows": (0x00280010, "US"), "Columns": (0x00280011, "US"), "PixelSpacing": (0x00280030, "DS"),
    "BitsAllocated": (0x00280100, "US"), "BitsStored": (0x00280101, "US"), "PixelRepresentation": (0x00280103, "US"), "RescaleIntercept": (0x00281052, "DS"), "RescaleSlope": (0x00281053, "DS"),
    "Units": (0x00541001, "CS"), "SegmentSequence": (0x00620002, "SQ"), "SegmentNumber": (0x00620004, "US"), "SegmentLabel": (0x00620005, "LO"), "SegmentDescription": (0x00620006, "ST"),
    "SegmentationType": (0x00620001, "CS"), "StructureSetLabel": (0x30060002, "SH"), "StructureSetDate": (0x30060008, "DA"), "StructureSetTime": (0x30060009, "TM"),
    "ReferencedFrameOfReferenceSequence": (0x30060010, "SQ"), "RTReferencedStudySequence": (0x30060012, "SQ"), "RTReferencedSeriesSequence": (0x30060014, "SQ"), "ContourImageSequence": (0x30060016, "SQ"),
    "StructureSetROISequence": (0x30060020, "SQ"), "ROINumber": (0x30060022, "IS"), "ROIName": (0x30060026, "LO"), "ROIGenerationAlgorithm": (0x30060036, "CS"), "ROIContourSequence": (0x30060039, "SQ"),
    "ContourSequence": (0x30060040, "SQ"), "ContourGeometricType": (0x30060042, "CS"), "NumberOfContourPoints": (0x30060046, "IS"), "ContourData": (0x30060050, "DS"),
    "ReferencedROINumber": (0x30060084, "IS"), "DoseUnits": (0x30040002, "CS"), "DoseType": (0x30040004, "CS"), "DoseGridScaling": (0x3004000E, "DS"),
    "ReferencedRTPlanSequence": (0x300C0002, "SQ"), "ReferencedStructureSetSequence": (0x300C0060, "SQ"), "RTPlanLabel": (0x300A0002, "SH"), "RTPlanDate": (0x300A0006, "DA"), "RTPlanTime": (0x300A0007, "TM"),
    "PixelData": (0x7FE00010, "OW"), "70531000": (0x70531000, "DS"), "70531009": (0x70531009, "DS"), "GridFrameOffsetVector": (0x3004000C, "DS"),
    "PixelMeasuresSequence": (0x00289110, "SQ"), "PlanePositionSequence": (0x00209113, "SQ"), "PlaneOrientationSequence": (0x00209116, "SQ"),
    "SharedFunctionalGroupsSequence": (0x52009229, "SQ"), "PerFrameFunctionalGroupsSequence": (0x52009230, "SQ"),
    "SegmentIdentificationSequence": (0x0062000A, "SQ"), "ReferencedSegmentNumber": (0x0062000B, "US"), "MaximumFractionalValue": (0x0062000E, "US"),
    "CurrentRequestedProcedureEvidenceSequence": (0x0040A375, "SQ"), "ReferencedSOPSequence": (0x00081199, "SQ"),
}
#: Fixed values from the DICOM data dictionary: the further fields that a modality's projection reads.
TAGS |= {
    "InstanceCreationDate": (0x00080012, "DA"), "InstanceCreationTime": (0x00080013, "TM"), "StationName": (0x00081010, "SH"), "AcquisitionContrast": (0x00089209, "CS"),
    "ContrastBolusAgent": (0x00180010, "LO"), "ScanningSequence": (0x00180020, "CS"), "SequenceVariant": (0x00180021, "CS"), "ScanOptions": (0x00180022, "CS"), "SequenceName": (0x00180024, "SH"),
    "Radiopharmaceutical": (0x00180031, "LO"), "AcquisitionTerminationCondition": (0x00180071, "CS"), "AcquisitionStartCondition": (0x00180073, "CS"), "NumberOfAverages": (0x00180083, "DS"),
    "ImagingFrequency": (0x00180084, "DS"), "DataCollectionDiameter": (0x00180090, "DS"), "EchoTrainLength": (0x00180091, "IS"), "PercentSampling": (0x00180093, "DS"),
    "PercentPhaseFieldOfView": (0x00180094, "DS"), "PixelBandwidth": (0x00180095, "DS"), "DeviceSerialNumber": (0x00181000, "LO"), "ContrastBolusVolume": (0x00181041, "DS"),
    "ContrastBolusStartTime": (0x00181042, "TM"), "ContrastBolusStopTime": (0x00181043, "TM"), "ContrastFlowRate": (0x00181046, "DS"), "ContrastFlowDuration": (0x00181047, "DS"),
    "ContrastBolusIngredient": (0x00181048, "CS"), "ContrastBolusIngredientConcentration": (0x00181049, "DS"), "FrameTime": (0x00181063, "DS"), "RadiopharmaceuticalRoute": (0x00181070, "LO"),
    "RadiopharmaceuticalVolume": (0x00181071, "DS"), "RadiopharmaceuticalStartTime": (0x00181072, "TM"), "RadionuclideTotalDose": (0x00181074, "DS"), "RadionuclideHalfLife": (0x00181075, "DS"),
    "RadionuclidePositronFraction": (0x00181076, "DS"), "RadiopharmaceuticalSpecificActivity": (0x00181077, "DS"), "RadiopharmaceuticalStartDateTime": (0x00181078, "DT"),
    "RadiopharmaceuticalStopDateTime": (0x00181079, "DT"), "ReconstructionDiameter": (0x00181100, "DS"), "GantryDetectorTilt": (0x00181120, "DS"), "TableMotion": (0x00181134, "CS"),
    "ActualFrameDuration": (0x00181242, "IS"), "TransmitCoilName": (0x00181251, "SH"), "DetectorType": (0x00187004, "CS"), "DetectorConfiguration": (0x00187005, "CS"),
    "ParallelReductionFactorInPlane": (0x00189069, "FD"), "DiffusionGradientDirectionSequence": (0x00189076, "SQ"), "ParallelAcquisitionTechnique": (0x00189078, "CS"),
    "ParallelReductionFactorOutOfPlane": (0x00189155, "FD"), "AcquisitionType": (0x00189302, "CS"), "SingleCollimationWidth": (0x00189306, "FD"), "TableSpeed": (0x00189309, "FD"),
    "SpiralPitchFactor": (0x00189311, "FD"), "DataCollectionCenterPatient": (0x00189313, "FD"), "ReconstructionAlgorithm": (0x00189315, "CS"), "ReconstructionFieldOfView": (0x00189317, "FD"),
    "ReconstructionTargetCenterPatient": (0x00189318, "FD"), "ExposureModulationType": (0x00189323, "CS"), "CTDIvol": (0x00189345, "FD"), "DiffusionBMatrixSequence": (0x00189601, "SQ"),
    "DecayCorrected": (0x00189758, "CS"), "NumberOfTemporalPositions": (0x00200105, "IS"), "TemporalResolution": (0x00200110, "DS"), "RescaleType": (0x00281054, "LO"),
    "EnergyWindowLowerLimit": (0x00540014, "DS"), "EnergyWindowUpperLimit": (0x00540015, "DS"), "NumberOfSlices": (0x00540081, "US"), "TimeSliceVector": (0x00540100, "US"),
    "RadiopharmaceuticalCodeSequence": (0x00540304, "SQ"), "SUVType": (0x00541006, "CS"), "AttenuationCorrectionMethod": (0x00541101, "LO"), "DecayCorrection": (0x00541102, "CS"),
    "ReconstructionMethod": (0x00541103, "LO"), "ScatterCorrectionMethod": (0x00541105, "LO"), "CoincidenceWindowWidth": (0x00541210, "DS"), "FrameReferenceTime": (0x00541300, "DS"),
    "DecayFactor": (0x00541321, "DS"), "DeadTimeCorrectionFlag": (0x00541401, "CS"), "SegmentationFractionalType": (0x00620010, "CS"), "DoseSummationType": (0x3004000A, "CS"),
    "StructureSetName": (0x30060004, "LO"), "RTPlanName": (0x300A0003, "LO"),
}
NAMES = {tag: name for name, (tag, _) in TAGS.items()}

#: The header fields of every modality.
BASE = (
    "PatientID", "SeriesInstanceUID", "StudyInstanceUID", "Modality", "BodyPartExamined", "DataCollectionDiameter", "FrameOfReferenceUID", "NumberOfSlices", "SliceThickness", "PatientPosition",
    "PixelSpacing", "ImageOrientationPatient", "ImagePositionPatient", "SpacingBetweenSlices", "RescaleType", "RescaleSlope", "RescaleIntercept", "Manufacturer", "ManufacturerModelName",
    "DeviceSerialNumber", "SoftwareVersions", "InstitutionName", "StationName", "ScanType", "ScanProgressionDirection", "ScanOptions", "AcquisitionNumber", "ProtocolName", "StudyDate", "StudyTime",
    "SeriesDate", "SeriesTime", "ContentDate", "ContentTime", "AcquisitionDate", "AcquisitionTime", "InstanceCreationDate", "InstanceCreationTime",
)
#: The header fields per modality, besides BASE.
BY_MODALITY: dict[str, tuple[str, ...]] = {
    "CT": (
        "ContrastFlowDuration", "ContrastFlowRate", "ContrastBolusAgent", "ContrastBolusVolume", "ContrastBolusStartTime", "ContrastBolusStopTime", "ContrastBolusIngredient",
        "ContrastBolusIngredientConcentration", "KVP", "XRayTubeCurrent", "ExposureTime", "Exposure", "ExposureModulationType", "CTDIvol", "ReconstructionAlgorithm", "ReconstructionDiameter",
        "ReconstructionMethod", "ReconstructionTargetCenterPatient", "ReconstructionFieldOfView", "ConvolutionKernel", "SpiralPitchFactor", "SingleCollimationWidth", "TableSpeed", "TableMotion",
        "GantryDetectorTilt", "DetectorType", "DetectorConfiguration", "DataCollectionCenterPatient",
    ),
    "MR": (
        "MagneticFieldStrength", "ImagingFrequency", "TransmitCoilName", "SequenceName", "ScanningSequence", "SequenceVariant", "AcquisitionContrast", "AcquisitionType", "EchoTime", "RepetitionTime",
        "InversionTime", "EchoTrainLength", "NumberOfAverages", "FlipAngle", "PercentSampling", "PercentPhaseFieldOfView", "PixelBandwidth", "SpacingBetweenSlices",
        "DiffusionGradientDirectionSequence", "DiffusionBMatrixSequence", "ParallelAcquisitionTechnique", "ParallelReductionFactorInPlane", "ParallelReductionFactorOutOfPlane",
        "NumberOfTemporalPositions", "TemporalResolution", "FrameReferenceTime",
    ),
    "PT": (
        "Radiopharmaceutical", "RadiopharmaceuticalStartTime", "RadionuclideTotalDose", "RadionuclideHalfLife", "RadionuclidePositronFraction", "RadiopharmaceuticalVolume",
        "RadiopharmaceuticalSpecificActivity", "RadiopharmaceuticalStartDateTime", "RadiopharmaceuticalStopDateTime", "RadiopharmaceuticalRoute", "RadiopharmaceuticalCodeSequence", "DecayCorrection",
        "DecayFactor", "AttenuationCorrectionMethod", "ScatterCorrectionMethod", "DecayCorrected", "DeadTimeCorrectionFlag", "ReconstructionMethod", "SUVType", "FrameReferenceTime", "FrameTime",
        "ActualFrameDuration", "AcquisitionStartCondition", "AcquisitionTerminationCondition", "TimeSliceVector", "DetectorType", "CoincidenceWindowWidth", "EnergyWindowLowerLimit",
        "EnergyWindowUpperLimit",
    ),
    "SEG": ("SegmentationType", "SegmentationFractionalType", "MaximumFractionalValue"),
    "RTSTRUCT": ("StructureSetLabel", "StructureSetName", "StructureSetDate", "StructureSetTime"),
    "RTDOSE": ("DoseType", "DoseUnits", "DoseSummationType", "DoseGridScaling"),
    "RTPLAN": ("RTPlanLabel", "RTPlanName", "RTPlanDate", "RTPlanTime"),
    "SR": ("SeriesDescription",),
}
#: Computed fields per modality: name to a function of the parsed header.  ``dicom`` fills those it knows.
COMPUTED: dict[str, dict[str, Callable[[dict], object]]] = {}


def register(modality: str, tags: tuple[str, ...], computed: dict[str, Callable[[dict], object]] | None = None) -> None:
    """Adds a modality's projection; one that is there is an ExistingExtractorError."""
    name = modality.upper()
    if name in BY_MODALITY:
        raise ExistingExtractorError(f"{name} is registered")
    BY_MODALITY[name], COMPUTED[name] = tuple(tags), dict(computed or {})


def supported_modalities() -> list[str]:
    return sorted(BY_MODALITY)


def keys_of(modality: str) -> list[str]:
    """Sorted output fields of a modality; unknown ones have the base fields."""
    return sorted({*BASE, *BY_MODALITY.get(modality.upper(), ()), *COMPUTED.get(modality.upper(), {})})


def tag_exists(keyword: str) -> bool:
    return keyword in TAGS


def lookup_tag(keyword: str, hexadecimal: bool = True) -> str | None:
    if keyword not in TAGS:
        return None
    return f"{TAGS[keyword][0]:08X}" if hexadecimal else str(TAGS[keyword][0])


def similar_tags(keyword: str, n: int = 3, threshold: float = 0.6) -> list[str]:
    return difflib.get_close_matches(keyword, TAGS, n=n, cutoff=threshold)


def tag_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, f"{t:08X}", vr) for k, (t, vr) in TAGS.items()], "keyword string, tag string, vr string")
