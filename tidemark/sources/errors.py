"""What can go wrong while data are read, each with a code for machines."""

from __future__ import annotations


class IngestionError(Exception):
    code = "INGESTION_ERROR"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.message, self.details = message, details

    def to_dict(self) -> dict:
        return {"code": self.code, "message": self.message, "details": self.details}


class UnsupportedFormatError(IngestionError):
    code = "UNSUPPORTED_FORMAT"


class ParseError(IngestionError):
    code = "PARSE_FAILED"


class EmptyDatasetError(IngestionError):
    code = "EMPTY_DATASET"


class CorruptRowsError(IngestionError):
    """Too many rows could not be read; ``frame`` holds those that could."""

    code = "CORRUPT_ROWS_EXCEEDED_THRESHOLD"

    def __init__(self, message: str, frame=None, **details):
        super().__init__(message, **details)
        self.frame = frame


class ValidationError(IngestionError):
    code = "VALIDATION_FAILED"


class SchemaError(IngestionError):
    code = "SCHEMA_ERROR"
