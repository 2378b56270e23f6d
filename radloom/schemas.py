"""Fixed record types, status vocabularies and the catalogue descriptor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

# --- fixed values: column names every image catalogue uses -----------------
STUDY = "StudyInstanceUID"
SERIES = "SeriesInstanceUID"
SOP = "SOPInstanceUID"
PATH = "RelativeFileArchiveURI"
EXTRACTION_KEYS = (SOP, SERIES, STUDY)

# --- fixed values: status vocabularies -------------------------------------
FILE_STATUSES = ("None", "Anonymised", "FileMissing", "ErrorWontRetry", "Copied")
VERIFIED_STATUSES = ("NotVerified", "NotIdentifiable", "IsIdentifiable", "ErrorWontRetry")
JOB_STATUSES = ("WaitingForCollectionInfo", "WaitingForStatuses", "ReadyForChecks", "Completed", "Failed")
CLASSIFICATIONS = ("None", "PrivateIdentifier", "Location", "Person", "Organization", "Money",
                   "Percent", "Date", "Time", "PixelText", "Postcode")
OPERATORS = ("=", "<>", "<", "<=", ">", ">=", "is", "is not", "like")

# Modalities kept apart in the document store; all others share one group.
MAJOR_MODALITIES = ("CR", "CT", "DX", "MG", "MR", "NM", "OT", "PR", "PT", "RF", "SR", "US", "XA")
OTHER_MODALITY = "OTHER"

MAX_DOCUMENT_BYTES = 16 * 1024 * 1024 - 512
MAX_IDS_PER_MESSAGE = 1000


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()

LINEAGE_HEADER = _struct(guid=_S, producer=_S, original_unix=_L, parents=T.ArrayType(_S))

IMAGE_RECORD = _struct(
    DicomFilePath=_S, DicomFileSize=_L, StudyInstanceUID=_S, SeriesInstanceUID=_S, SOPInstanceUID=_S, DicomDataset=_S,
)
SERIES_RECORD = _struct(
    DirectoryPath=_S, StudyInstanceUID=_S, SeriesInstanceUID=_S, ImagesInSeries=_L, DicomDataset=_S,
)
DIRECTORY_RECORD = _struct(DirectoryPath=_S)

_JOB = dict(job_id=_S, project=_S, directory=_S, modality=_S, submitted_at=_TS,
            identifiable=_B, no_filters=_B, pooled=_B)
EXTRACTION_REQUEST = _struct(**_JOB, key_tag=_S, identifiers=T.ArrayType(_S))
JOB_INFO = _struct(**_JOB, key_tag=_S, key_count=_L, user_name=_S)
# One head row (part 0) per key; the files of the key follow in bounded parts.
COLLECTION_INFO = _struct(**_JOB, key_pos=_L, key_value=_S, part=_I, files=T.ArrayType(_S),
                          reasons=T.MapType(_S, _L))
FILE_STATUS = _struct(**_JOB, file_path=_S, output_path=_S, status=_S, message=_S)
VERIFICATION = _struct(**_JOB, file_path=_S, output_path=_S, status=_S, report=_S)

FAILURE_PART = _struct(Classification=_S, Offset=_I, Word=_S)
FAILURE = _struct(Parts=T.ArrayType(FAILURE_PART), Resource=_S, ResourcePrimaryKey=_S,
                  ProblemField=_S, ProblemValue=_S)
FAILURE_REPORT = T.ArrayType(FAILURE)


@dataclass(frozen=True)
class Catalogue:
    """A queryable image table with the filters that always apply to it.

    ``unique`` says that the image UID is its primary key.
    """

    name: str
    df: DataFrame
    mandatory_filters: tuple[str, ...] = ()
    unique: bool = False

    def column(self, wanted: str) -> str | None:
        """Name of ``wanted`` as the table spells it, ignoring case."""
        return next((c for c in self.df.columns if c.lower() == wanted.lower()), None)
