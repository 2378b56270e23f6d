"""Relational image templates: YAML text to tables, keys and Spark types."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import yaml
from pyspark.sql import types as T

# --- fixed values: data dictionary entries the usual templates need ---------
TAG_OF_KEYWORD = {
    "TransferSyntaxUID": "00020010",
    "SourceApplicationEntityTitle": "00020016",
    "SpecificCharacterSet": "00080005",
    "ImageType": "00080008",
    "SOPClassUID": "00080016",
    "SOPInstanceUID": "00080018",
    "StudyDate": "00080020",
    "SeriesDate": "00080021",
    "AcquisitionDate": "00080022",
    "ContentDate": "00080023",
    "StudyTime": "00080030",
    "SeriesTime": "00080031",
    "AcquisitionTime": "00080032",
    "ContentTime": "00080033",
    "AccessionNumber": "00080050",
    "Modality": "00080060",
    "ModalitiesInStudy": "00080061",
    "Manufacturer": "00080070",
    "InstitutionName": "00080080",
    "CodeMeaning": "00080104",
    "StationName": "00081010",
    "StudyDescription": "00081030",
    "ProcedureCodeSequence": "00081032",
    "SeriesDescription": "0008103E",
    "ManufacturerModelName": "00081090",
    "LossyImageCompressionRetired": "00082110",
    "DerivationDescription": "00082111",
    "DerivationCodeSequence": "00089215",
    "PatientName": "00100010",
    "PatientID": "00100020",
    "PatientBirthDate": "00100030",
    "PatientSex": "00100040",
    "PatientAge": "00101010",
    "PatientSize": "00101020",
    "PatientWeight": "00101030",
    "ContrastBolusAgent": "00180010",
    "BodyPartExamined": "00180015",
    "ScanningSequence": "00180020",
    "SequenceVariant": "00180021",
    "ScanOptions": "00180022",
    "MRAcquisitionType": "00180023",
    "SequenceName": "00180024",
    "SliceThickness": "00180050",
    "KVP": "00180060",
    "RepetitionTime": "00180080",
    "EchoTime": "00180081",
    "InversionTime": "00180082",
    "NumberOfAverages": "00180083",
    "ImagingFrequency": "00180084",
    "EchoNumbers": "00180086",
    "MagneticFieldStrength": "00180087",
    "SpacingBetweenSlices": "00180088",
    "EchoTrainLength": "00180091",
    "PixelBandwidth": "00180095",
    "DeviceSerialNumber": "00181000",
    "SoftwareVersions": "00181020",
    "ProtocolName": "00181030",
    "ContrastBolusRoute": "00181040",
    "ReconstructionDiameter": "00181100",
    "GantryDetectorTilt": "00181120",
    "FieldOfViewDimensions": "00181149",
    "ExposureTime": "00181150",
    "XRayTubeCurrent": "00181151",
    "Exposure": "00181152",
    "FilterType": "00181160",
    "FocalSpots": "00181190",
    "ConvolutionKernel": "00181210",
    "FlipAngle": "00181314",
    "PatientPosition": "00185100",
    "ViewPosition": "00185101",
    "SpiralPitchFactor": "00189311",
    "FieldOfViewDimensionsInFloat": "00189461",
    "StudyInstanceUID": "0020000D",
    "SeriesInstanceUID": "0020000E",
    "StudyID": "00200010",
    "SeriesNumber": "00200011",
    "AcquisitionNumber": "00200012",
    "InstanceNumber": "00200013",
    "ImagePositionPatient": "00200032",
    "ImageOrientationPatient": "00200037",
    "FrameOfReferenceUID": "00200052",
    "Laterality": "00200060",
    "ImageLaterality": "00200062",
    "SliceLocation": "00201041",
    "NumberOfStudyRelatedInstances": "00201206",
    "NumberOfSeriesRelatedInstances": "00201209",
    "SamplesPerPixel": "00280002",
    "PhotometricInterpretation": "00280004",
    "NumberOfFrames": "00280008",
    "Rows": "00280010",
    "Columns": "00280011",
    "PixelSpacing": "00280030",
    "BitsAllocated": "00280100",
    "BitsStored": "00280101",
    "BurnedInAnnotation": "00280301",
    "WindowCenter": "00281050",
    "WindowWidth": "00281051",
    "RescaleIntercept": "00281052",
    "RescaleSlope": "00281053",
    "LossyImageCompression": "00282110",
    "LossyImageCompressionRatio": "00282112",
    "LossyImageCompressionMethod": "00282114",
    "PerformedProcedureStepID": "00400253",
    "PerformedProcedureStepDescription": "00400254",
    "AcquisitionContextSequence": "00400555",
    "WedgeAngleFloat": "300A0118",
    "PixelData": "7FE00010",
}

# SQL type names a template may state, and what they become.
_PLAIN_TYPES = {
    "int": T.IntegerType(), "smallint": T.ShortType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "float": T.DoubleType(), "bit": T.BooleanType(), "datetime": T.TimestampType(), "date": T.DateType(),
    "time": T.StringType(), "text": T.StringType(),
}
_SIZED = re.compile(r"(varchar|char|decimal)\((\d+)(?:\s*,\s*(\d+))?\)", re.IGNORECASE)


@dataclass(frozen=True)
class TemplateColumn:
    name: str
    dtype: T.DataType = T.StringType()
    max_length: int | None = None
    primary_key: bool = False
    nullable: bool = True
    tag: str | None = None


@dataclass(frozen=True)
class TemplateTable:
    name: str
    columns: tuple[TemplateColumn, ...] = field(default_factory=tuple)

    @property
    def key(self) -> str:
        return next(c.name for c in self.columns if c.primary_key)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.dtype, c.nullable) for c in self.columns])


_HEX = re.compile(r"[0-9A-F]{8}")


def _hex(tag: str | None) -> str | None:
    if tag is None:
        return None
    plain = re.sub(r"[(),\s]", "", str(tag)).upper()
    if not _HEX.fullmatch(plain):
        raise ValueError(f"{tag} is not a tag of 8 hex digits")
    return plain


def load_tags(text: str) -> dict[str, str]:
    """A tag table from ``keyword: tag`` lines (YAML), added to the built-in one."""
    return {**TAG_OF_KEYWORD, **{str(k): _hex(v) for k, v in (yaml.safe_load(text) or {}).items()}}


def tag_of(name: str, tags_of: dict[str, str]) -> str | None:
    """The tag of a keyword, or the name itself if it is 8 hex digits."""
    return tags_of.get(name) or (name.upper() if _HEX.fullmatch(name.upper()) else None)


def require_tags(names: Iterable[str], tags_of: dict[str, str]) -> dict[str, str]:
    """The tag of every name; all names without one are one error."""
    found = {n: tag_of(n, tags_of) for n in names}
    unknown = sorted(n for n, tag in found.items() if tag is None)
    if unknown:
        raise ValueError(f"no tag is known for: {', '.join(unknown)}")
    return found


def sql_type(text: str | None) -> tuple[T.DataType, int | None]:
    """Spark type and maximum text length for a template's SQL type name."""
    if not text:
        return T.StringType(), None
    sized = _SIZED.fullmatch(text.strip())
    if sized:
        kind, size, scale = sized.group(1).lower(), int(sized.group(2)), sized.group(3)
        if kind == "decimal":
            return T.DecimalType(size, int(scale or 0)), None
        return T.StringType(), size
    return _PLAIN_TYPES[text.strip().lower()], None


def load_template(text: str) -> dict[str, TemplateTable]:
    """Read a template: ``Tables: [{TableName, Columns: [...]}]``; a column may name its ``Tag``."""
    tables = {}
    for table in yaml.safe_load(text)["Tables"]:
        columns = []
        for col in table["Columns"]:
            explicit = (col.get("Type") or {}).get("CSharpType") if isinstance(col.get("Type"), dict) else col.get("Type")
            dtype, width = sql_type(explicit) if explicit and (
                explicit.lower() in _PLAIN_TYPES or _SIZED.fullmatch(explicit)) else (T.StringType(), None)
            key = bool(col.get("IsPrimaryKey"))
            columns.append(TemplateColumn(col["ColumnName"], dtype, col.get("MaxLength") or width, key,
                                          bool(col.get("AllowNulls")) and not key, _hex(col.get("Tag"))))
        tables[table["TableName"]] = TemplateTable(table["TableName"], tuple(columns))
    return tables
