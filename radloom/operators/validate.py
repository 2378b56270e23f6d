"""Checks that split good rows from bad ones instead of failing the job."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from radloom.functions import paths
from radloom.functions.joins import join_side, unique_side
from radloom.functions.tags import entry_values, parse_items
from radloom.functions.text import blank_to_null, is_blank
from radloom.schemas import (EXTRACTION_KEYS, FAILURE_REPORT, MAX_DOCUMENT_BYTES, OPERATORS, SERIES, SOP, STUDY)
from radloom.template import TemplateTable

WIDTH_MODES = ("none", "truncate", "null", "corrupt")
CAST_MODES = ("null", "throw", "corrupt")


def require_ids(df: DataFrame, ids: tuple[str, ...] = (STUDY, SERIES, SOP)) -> DataFrame:
    """Add ``bad``: which of the identifiers are missing or blank."""
    lacking = F.array_compact(F.array(*[F.when(is_blank(F.col(c)), F.lit(c)) for c in ids]))
    return df.withColumn("bad", F.when(F.size(lacking) > 0, F.concat(F.lit("missing ID: "), F.array_join(lacking, ","))))


def drop_bad(df: DataFrame, directory: str, nack_if_any: bool, bad: str = "bad") -> DataFrame:
    """Drop bad files; with ``nack_if_any`` one bad file drops its directory.

    Bad directories are found among the bad files and removed by an anti join, so
    a directory of any size is never brought together.
    """
    good = df.where(F.col(bad).isNull())
    if not nack_if_any:
        return good
    spoiled = unique_side(df.where(F.col(bad).isNotNull()), directory)
    return good.join(spoiled, directory, "left_anti")


def enforce_width(df: DataFrame, limits: dict[str, int], mode: str) -> DataFrame:
    """Apply a maximum length per text column.

    ``truncate`` cuts, ``null`` empties, ``corrupt`` only marks the row in
    ``corrupt``.  ``warnings`` names every column that was too wide.
    """
    if mode not in WIDTH_MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "none":
        return df.withColumn("warnings", F.array().cast("array<string>")).withColumn("corrupt", F.lit(False))
    wide = {c: F.coalesce(F.length(c) > n, F.lit(False)) for c, n in limits.items()}
    named = F.array_compact(F.array(*[F.when(w, F.lit(c)) for c, w in wide.items()]))
    changed = []
    for c in df.columns:
        if c not in wide or mode == "corrupt":
            changed.append(F.col(c))
        elif mode == "truncate":
            changed.append(F.substring(c, 1, limits[c]).alias(c))
        else:
            changed.append(F.when(~wide[c], F.col(c)).alias(c))
    flag = F.size(named) > 0 if mode == "corrupt" else F.lit(False)
    return df.select(*changed, named.alias("warnings"), flag.alias("corrupt"))


def cast_tags(df: DataFrame, table: TemplateTable, mode: str, guid: str = "MessageGuid",
              path: str = "RelativeFileArchiveURI") -> DataFrame:
    """Cast text columns to their template types.

    A value that does not fit becomes null with a warning naming column, message
    and file (``null``), fails the job (``throw``), or marks the row (``corrupt``).
    """
    if mode not in CAST_MODES:
        raise ValueError(f"unknown mode {mode}")
    typed = {c.name: c for c in table.columns if c.name in df.columns and c.dtype.simpleString() != "string"}
    failed, cells = [], []
    where = F.concat(*[F.concat(F.lit(f" {label}="), F.coalesce(F.col(c), F.lit(""))) if c in df.columns else F.lit("")
                       for label, c in ((guid, guid), ("file", path))])
    for name in df.columns:
        if name not in typed:
            cells.append(F.col(name))
            continue
        value = F.col(name).try_cast(typed[name].dtype)
        wrong = value.isNull() & ~is_blank(F.col(name))
        if mode == "throw":
            value = F.when(wrong, F.raise_error(F.concat(F.lit(f"bad value in {name}: "), F.col(name)))).otherwise(value)
        cells.append(value.alias(name))
        failed.append(F.when(wrong, F.concat(F.lit(name), where)))
    warnings = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    flag = F.size(warnings) > 0 if mode == "corrupt" else F.lit(False)
    return df.select(*cells, warnings.alias("warnings"), flag.alias("corrupt"))


# --- fixed values: value representations that hold numbers ---------------------
NUMBER_VRS = ("DS", "IS", "FL", "FD", "SL", "SS", "UL", "US")


def check_sequences(df: DataFrame, columns: list[str], mode: str = "null", guid: str = "MessageGuid",
                    path: str = "RelativeFileArchiveURI") -> DataFrame:
    """Sequence columns (JSON of items) in which every number is one.

    One value that is no number makes the whole sequence unusable: it becomes
    null with a warning (``null``), fails the job (``throw``) or marks the row
    (``corrupt``), as :func:`cast_tags` does for plain columns.
    """
    if mode not in CAST_MODES:
        raise ValueError(f"unknown mode {mode}")
    where = F.concat(*[F.concat(F.lit(f" {label}="), F.coalesce(F.col(c), F.lit(""))) if c in df.columns else F.lit("")
                       for label, c in ((guid, guid), ("file", path))])

    def bad_entry(entry: Column) -> Column:
        return F.coalesce(entry["vr"].isin(*NUMBER_VRS), F.lit(False)) & F.exists(
            entry_values(entry), lambda v: v.try_cast("double").isNull() & ~is_blank(v))

    cells, failed = {}, []
    for name in columns:
        items = parse_items(F.col(name))
        wrong = F.coalesce(F.exists(items, lambda item: F.exists(F.map_values(item), bad_entry)), F.lit(False))
        stop = F.raise_error(F.concat(F.lit(f"bad value in {name}"), where)).cast("string")
        cells[name] = F.when(wrong, stop if mode == "throw" else F.lit(None).cast("string") if mode == "null" else F.col(name)).otherwise(F.col(name))
        failed.append(F.when(wrong, F.concat(F.lit(name), where)))
    warnings = F.array_compact(F.array(*failed))
    return df.select(*[cells[c].alias(c) if c in cells else F.col(c) for c in df.columns], warnings.alias("warnings"),
                     (F.size(warnings) > 0 if mode == "corrupt" else F.lit(False)).alias("corrupt"))


def guard_size(df: DataFrame, limit: int = MAX_DOCUMENT_BYTES) -> DataFrame:
    """Add ``too_large``: whether the row as a document exceeds the limit."""
    return df.withColumn("too_large", F.octet_length(F.to_json(F.struct(*df.columns))) > limit)


def validate_requests(df: DataFrame) -> DataFrame:
    """Add ``bad``: the extraction directory must start with the project."""
    ok = F.coalesce(F.startswith(F.col("directory"), F.col("project")), F.lit(False))
    return df.withColumn("bad", F.when(~ok, F.lit("ExtractionDirectory")))


@dataclass(frozen=True)
class ExtractionOptions:
    """Options of one extraction, checked before anything is planned."""

    key: str
    identifiable: bool = False
    no_filters: bool = False
    pooled: bool = False
    max_ids_per_message: int = 1000
    allowed_keys: tuple[str, ...] = EXTRACTION_KEYS

    def validate(self) -> "ExtractionOptions":
        if self.pooled and self.identifiable:
            raise ValueError("pooled is incompatible with identifiable extraction")
        if self.pooled and self.no_filters:
            raise ValueError("pooled is incompatible with no-filters extraction")
        if self.key not in self.allowed_keys:
            raise ValueError(f"'{self.key}' is not an allowed extraction key: {','.join(self.allowed_keys)}")
        if self.max_ids_per_message <= 0:
            raise ValueError("max identifiers per message must be positive")
        return self


def validate_status(df: DataFrame) -> DataFrame:
    """Add ``bad`` to file statuses that may not arrive on the failure route."""
    return df.withColumn("bad", F.when(F.coalesce(F.col("status"), F.lit("None")) == "None", F.lit("status was None"))
                         .when(F.col("status") == "Anonymised", F.lit("success on the failure route")))


def parse_report(report: Column) -> Column:
    """Failure list of a verification report; null if it is not one.

    Single-quoted JSON is accepted too.
    """
    return F.from_json(report, FAILURE_REPORT)


def validate_verification(df: DataFrame) -> DataFrame:
    """Add ``bad`` to verification events, and ``failures`` from their report.

    A report that cannot be read as a failure list is an error, except on a file
    that could not be screened: that report is a free-text message.
    """
    failures = parse_report(F.col("report"))
    screened = F.col("status") != "ErrorWontRetry"
    return df.withColumn("failures", F.when(screened, failures)).withColumn(
        "bad",
        F.when(is_blank(F.col("output_path")), F.lit("no output path"))
        .when(is_blank(F.col("report")), F.lit("no report"))
        .when((F.col("status") == "IsIdentifiable") & (F.col("report") == "[]"), F.lit("identifiable without failures"))
        .when(screened & F.col("failures").isNull(), F.lit("report is not JSON")))


@dataclass(frozen=True)
class UpdateSpec:
    """Which rows to change and what to write into them."""

    where_fields: list[str]
    have_values: list
    write_fields: list[str]
    values: list
    operators: list[str] | None = None
    tables: list[str] = field(default_factory=list)

    def validate(self) -> "UpdateSpec":
        if len(self.where_fields) != len(self.have_values):
            raise ValueError("where fields and values differ in number")
        if len(self.write_fields) != len(self.values):
            raise ValueError("written fields and values differ in number")
        if not self.where_fields:
            raise ValueError("there must be at least one search field")
        if not self.write_fields:
            raise ValueError("there must be at least one value to write")
        if self.operators is not None:
            if len(self.operators) != len(self.where_fields):
                raise ValueError("operators and where fields differ in number")
            unknown = [op for op in self.operators if op and op.lower() not in OPERATORS]
            if unknown:
                raise ValueError(f"operator {unknown[0]} is not allowed")
        return self


def rebuild_messages(docs: DataFrame) -> DataFrame:
    """Image messages from stored documents; ``bad`` says why one is unusable.

    ``header`` is a struct, ``dataset`` the tag JSON beside it.  An unknown file
    size is -1.
    """
    ids = [STUDY, SERIES, SOP]
    message = docs.select(
        *[c for c in docs.columns if c not in ("header", "dataset", *ids)],
        F.col("header").isNull().alias("_no_header"),
        F.col("header.DicomFilePath").alias("DicomFilePath"),
        F.coalesce(F.col("header.DicomFileSize"), F.lit(-1).cast("long")).alias("DicomFileSize"),
        *[blank_to_null(F.col(c)).alias(c) for c in ids],
        F.col("dataset").alias("DicomDataset"),
    )
    blank = F.lit(False)
    for c in ("DicomFilePath", *ids, "DicomDataset"):
        blank = blank | is_blank(F.col(c))
    return message.withColumn("bad", F.when(F.col("_no_header"), F.lit("no header"))
                              .when(blank, F.lit("message was not valid"))).drop("_no_header")


def require_below_root(dirs: DataFrame, files: DataFrame, root: str, pattern: str = "*.dcm") -> DataFrame:
    """Add ``bad`` to directories outside the root or without readable files."""
    name = paths.file_name(F.col("path"))
    counts = (files.where(paths.like_glob(name, pattern) | paths.is_archive(F.col("path")))
              .groupBy(paths.parent_dir(F.col("path")).alias("dir")).agg(F.count("*").alias("n_files")))
    return (dirs.join(join_side(counts, "dir"), "dir", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
            .withColumn("bad", F.when(~paths.below_root(F.col("dir"), root), F.lit("not below root"))
                        .when(F.col("n_files") == 0, F.lit("no files"))))
