"""Errors raised on the driver."""


class EngineError(Exception):
    """Base of the engine's errors."""


class InterlacerQueryError(EngineError):
    """A modality query that cannot be answered."""


class UnsupportedModalityError(InterlacerQueryError):
    pass


class MissingDependencyModalityError(InterlacerQueryError):
    pass


class DuplicateRowError(EngineError):
    pass


class NoValidSamplesError(EngineError):
    pass


class InvalidDicomError(EngineError):
    pass


class InvalidPatternError(EngineError):
    pass


class MissingPlaceholderValueError(EngineError):
    pass


class InvalidDICOMKeyError(EngineError):
    pass


class ROIMatchingError(EngineError):
    pass


class MissingROIError(EngineError):
    pass


class TooManyComponentsError(EngineError):
    pass


class OverlappingMasksError(EngineError, ValueError):
    pass


class IndexSchemaMismatchError(EngineError):
    pass


class RTSTRUCTAttributeError(EngineError):
    pass


class ROIContourError(EngineError):
    pass


class SegmentationError(EngineError):
    """A segmentation that cannot be read."""


class SegmentDuplicateError(SegmentationError):
    pass


class SegmentDataMissingError(SegmentationError):
    pass


class SegmentationTypeUnsupportedError(SegmentationError):
    pass


class SegmentReferenceIndicesError(SegmentationError):
    pass


class SegmentationValidationError(SegmentationError):
    pass


class NoSegmentationImagesError(EngineError):
    pass


class MissingROIsError(EngineError):
    pass


class CrawlResultsNotAvailableError(EngineError):
    pass


class ExistingExtractorError(EngineError):
    pass


class WriterIndexError(EngineError):
    pass


class MaskSavingStrategyError(EngineError, ValueError):
    pass
