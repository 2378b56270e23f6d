"""Archive paths: splitting, relativising and the layouts of extracted files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from radloom.schemas import PATH, SERIES, SOP, STUDY
from radloom.functions.text import is_blank

# --- fixed values: extensions ------------------------------------------------
ANONYMISED_EXT = "-an.dcm"
IDENTIFIABLE_EXT = ".dcm"
REPLACEABLE_EXTS = (".dcm", ".dicom")
ARCHIVE_EXTS = (".zip", ".tar")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Everything before the last ``/``; empty text at the top level."""
    # Plain searches from the end; a pattern would be tried again at every character.
    return F.substring(path, F.lit(1), F.greatest(F.length(path) - F.length(file_name(path)) - 1, F.lit(0)))


def extension(path: Column) -> Column:
    """Last extension with its dot, empty text if there is none."""
    return F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1)


def is_archive(path: Column) -> Column:
    return extension(path).isin(*ARCHIVE_EXTS)


def like_glob(name: Column, pattern: str) -> Column:
    """Match a ``*``/``?`` file pattern."""
    escaped = "".join({"*": ".*", "?": "."}.get(ch, "\\" + ch if ch in r"\.[]{}()+-^$|" else ch) for ch in pattern)
    return name.rlike(f"^{escaped}$")


def ancestors(directory: Column) -> Column:
    """All proper ancestors of a directory, the empty root first."""
    parts = F.split(directory, "/")
    depth = F.size(parts)
    up = F.transform(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))),
                     lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    root = F.array(F.lit(""))
    return (F.when(directory == "", F.array().cast("array<string>"))
            .when(depth > 1, F.array_union(root, up)).otherwise(root))


def below_root(path: Column, root: str) -> Column:
    return F.startswith(F.lower(path), F.lit(root.lower()))


def relativise(path: Column, root: str) -> Column:
    """Path without ``root`` and outer separators; null when not below it."""
    rest = F.substring(path, len(root) + 1, 1 << 30)
    return F.when(below_root(path, root), F.trim(rest, F.lit("/\\")))


def normalise(path: Column) -> Column:
    """Drop leading separators and use forward slashes."""
    return F.translate(F.ltrim(path, F.lit("/\\")), "\\", "/")


def extraction_name(directory: Column) -> Column:
    """Last part of an extraction directory."""
    return F.regexp_extract(directory, r"([^/\\]*)[/\\]*$", 1)


def project_dir(directory: Column) -> Column:
    """Everything before the last part of an extraction directory."""
    return F.regexp_replace(directory, r"[/\\]?[^/\\]*[/\\]*$", "")


def _suffix(identifiable: Column) -> Column:
    return F.when(identifiable, IDENTIFIABLE_EXT).otherwise(ANONYMISED_EXT)


def out_path_sop(identifiable: Column, study: str = STUDY, series: str = SERIES, sop: str = SOP) -> Column:
    """study / series / instance plus the suffix of the extraction kind."""
    return F.concat_ws("/", F.col(study), F.col(series), F.concat(F.col(sop), _suffix(identifiable)))


def out_path_name(identifiable: Column, path: str = PATH, study: str = STUDY, series: str = SERIES) -> Column:
    """study / series / original file name with a standard suffix.

    A name ending in a known extension has every occurrence of it replaced;
    any other name gets the suffix appended.
    """
    name, suffix = file_name(F.col(path)), _suffix(identifiable)
    renamed = F.when(is_blank(name), F.raise_error(F.concat(F.lit("no file name in "), F.col(path))))
    for ext in REPLACEABLE_EXTS:
        renamed = renamed.when(name.endswith(ext), F.replace(name, F.lit(ext), suffix))
    return F.concat_ws("/", F.col(study), F.col(series), renamed.otherwise(F.concat(name, suffix)))


def out_path_nosuffix(identifiable: Column, path: str = PATH, study: str = STUDY, series: str = SERIES) -> Column:
    """As :func:`out_path_name`, with every ``-an`` taken out again."""
    return F.replace(out_path_name(identifiable, path, study, series), F.lit("-an"), F.lit(""))


RESOLVERS = {"study_series_sop": out_path_sop, "study_series_name": out_path_name, "no_suffix": out_path_nosuffix}
