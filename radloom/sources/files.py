"""File inspection: kind by magic bytes, archive entries, path filters."""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values ---------------------------------------------------------------
MAGIC = "DICM"
MAGIC_OFFSET = 128


def read_files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def classify_files(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``kind``: ``dicom`` when bytes 128..131 are the magic, else ``archive``.

    Anything that is not an image file is then tried as an archive.
    """
    magic = F.substring(F.col(content), MAGIC_OFFSET + 1, len(MAGIC))
    is_image = (F.octet_length(F.col(content)) >= MAGIC_OFFSET + len(MAGIC)) & (magic.cast("string") == MAGIC)
    return files.withColumn("kind", F.when(is_image, "dicom").otherwise("archive"))


def _entries(path: str, content: bytes) -> Iterator[tuple[int, str, bytes]]:
    stream = io.BytesIO(content)
    if zipfile.is_zipfile(stream):
        with zipfile.ZipFile(stream) as archive:
            members = [m for m in archive.infolist() if not m.is_dir()]
            for at, member in enumerate(members):
                yield at, member.filename, archive.read(member)
        return
    stream.seek(0)
    with tarfile.open(fileobj=stream) as archive:
        for at, member in enumerate(m for m in archive if m.isfile()):
            yield at, member.name, archive.extractfile(member).read()


def explode_archive(files: DataFrame, for_tag_reader: bool = False, with_content: bool = True) -> DataFrame:
    """One row per archive entry, addressed ``archive!entry``.

    The tag reader takes only ``.dcm`` entries (any case) and does not know their
    size (-1); the bulk loader takes every non-empty entry with its size.  An
    unreadable archive gives one row with ``error`` set.
    """
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                try:
                    for at, name, body in _entries(path, bytes(content)):
                        if for_tag_reader and not name.lower().endswith(".dcm"):
                            continue
                        if not for_tag_reader and not body:
                            continue
                        size = -1 if for_tag_reader else len(body)
                        rows.append((path, f"{path}!{name}", at, size, body if with_content else None, None))
                        if len(rows) >= 64:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except (zipfile.BadZipFile, tarfile.TarError, zlib.error, OSError, EOFError, RuntimeError, ValueError, KeyError) as problem:
                    # Damaged, encrypted or of an unknown compression: one row, and the other archives go on.
                    rows.append((path, None, None, None, None, f"{type(problem).__name__}: {problem}"))
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    columns = ["archive", "path", "entry_pos", "size", "content", "error"]
    return files.select("path", "content").mapInPandas(
        expand, "archive string, path string, entry_pos int, size long, content binary, error string")


def find_files(files: DataFrame, include: str | Column) -> DataFrame:
    """Only the named file, or only the paths a predicate accepts."""
    return files.where(F.col("path") == include if isinstance(include, str) else include)
