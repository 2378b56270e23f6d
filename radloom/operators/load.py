"""Loading: roll-ups, de-duplication, level tables, isolation and merging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from radloom.functions.joins import join_side, unique_side
from radloom.operators.project import project_common
from radloom.schemas import MAJOR_MODALITIES, OTHER_MODALITY, SERIES, SOP, STUDY
from radloom.session import kept, pin
from radloom.template import TemplateTable


def modality_group(modality: Column) -> Column:
    """The modality if it has a group of its own, else the shared group."""
    return F.when(modality.isin(*MAJOR_MODALITIES), modality).otherwise(OTHER_MODALITY)


def series_from_images(images: DataFrame, directory: str = "DirectoryPath", path: str = "DicomFilePath",
                       dataset: str = "DicomDataset") -> DataFrame:
    """One row per directory and series: image count and a representative.

    The representative is the tag set of the first path, which does not depend on
    read order.
    """
    first = F.min(F.struct(path, STUDY, dataset))
    grouped = images.groupBy(directory, SERIES).agg(F.count("*").alias("ImagesInSeries"), first.alias("_first"))
    return grouped.select(directory, SERIES, f"_first.{STUDY}", "ImagesInSeries", f"_first.{dataset}")


def recount_series(images: DataFrame) -> DataFrame:
    """Image count per series over everything stored."""
    return images.groupBy(SERIES).agg(F.count("*").alias("ImagesInSeries"))


def dedupe_batch(df: DataFrame, dataset: str = "DicomDataset") -> DataFrame:
    """One row per exact tag-set text; rows without a text are no copies of each other and stay.

    The copies meet on a digest of the text, so the text itself is not a shuffle
    key; partial aggregation removes most copies before the shuffle.
    """
    whole = df.where(F.col(dataset).isNotNull())
    first = F.min(F.struct(*[F.col(c) for c in df.columns if c != dataset]))
    grouped = whole.groupBy(F.sha2(dataset, 256).alias("_digest")).agg(first.alias("_first"), F.min(dataset).alias(dataset))
    return grouped.select("_first.*", dataset).unionByName(df.where(F.col(dataset).isNull()))


def split_levels(flat: DataFrame, template: dict[str, TemplateTable]) -> dict[str, DataFrame]:
    """Distinct rows per template table from flat image rows."""
    return {name: flat.select(*[c for c in table.names if c in flat.columns]).distinct()
            for name, table in template.items()}


def join_levels(study: DataFrame, series: DataFrame, image: DataFrame) -> DataFrame:
    """Study, series and image rows side by side."""
    return image.join(join_side(series, SERIES), SERIES).join(join_side(study, STUDY), STUDY)


def colliding_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys held by more than one different row.

    Rows are compared by a 64-bit hash of their other columns, nulls included, so that one shuffle of the keys does.
    """
    others = [c for c in df.columns if c != key]
    if not others:
        return df.select(key).limit(0)
    row = F.xxhash64(*[e for c in others for e in (F.col(c).isNull(), F.col(c))])
    held = df.select(key, row.alias("_row")).groupBy(key).agg(F.min("_row").alias("_lo"), F.max("_row").alias("_hi"))
    return held.where(F.col("_lo") != F.col("_hi")).select(key)


@dataclass(frozen=True)
class Isolated:
    """The same three levels twice: fit to load, and set aside."""

    good: dict[str, DataFrame]
    bad: dict[str, DataFrame]


def isolate(study: DataFrame, series: DataFrame, image: DataFrame) -> Isolated:
    """Set aside every study that is connected to a primary key that is not unique.

    A bad key at any level takes its whole study along: the study row, all its
    series and all their images, so no good row is left without its parent and
    no parent without part of its children.  The bad keys that follow from collisions are
    stored, so that joins go by their measured size; every result is then one pass over its level.
    Rows may repeat, and stay repeated; a row whose own key is null is never set aside.
    """
    bad_study, bad_series, bad_image = (colliding_keys(d, k) for d, k in ((study, STUDY), (series, SERIES), (image, SOP)))
    bad_image = kept(bad_image)
    touched = kept(bad_series.union(_among(image, bad_image, SOP).select(SERIES)).distinct())
    studies = kept(bad_study.union(_among(series, touched, SERIES).select(STUDY)).distinct())
    # A bad series without a row of a study of its own (an orphan) still goes by its key.
    all_series = _among(series, studies, STUDY).select(SERIES).union(touched).distinct()
    # A key that two different rows hold is bad itself, so a row goes by its own parent and key.
    levels = {"study": (study, STUDY, [(STUDY, studies)]),
              "series": (series, SERIES, [(STUDY, studies), (SERIES, touched)]),
              "image": (image, SOP, [(SERIES, all_series), (SOP, bad_image)])}
    good, bad = {}, {}
    for name, (df, key, lists) in levels.items():
        marked = df
        for at, (column, listed) in enumerate(lists):
            members = join_side(listed.select(F.col(column).alias(f"_of_{at}")), f"_of_{at}").withColumn(f"_bad_{at}", F.lit(True))
            marked = marked.join(members, F.col(column) == F.col(f"_of_{at}"), "left")
        aside = F.col(key).isNotNull() & F.coalesce(*[F.col(f"_bad_{at}") for at in range(len(lists))], F.lit(False))
        good[name], bad[name] = marked.where(~aside).select(*df.columns), marked.where(aside).select(*df.columns)
    return Isolated(good, bad)


def _among(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return df.join(join_side(members.select(key), key), key, "left_semi")


def split_corrupt(batch: DataFrame, corrupt: DataFrame, key: str) -> DataFrame:
    """The batch without rows that share a key with corrupt ones, and without rows that have no key; repeated rows stay repeated."""
    return batch.where(F.col(key).isNotNull()).join(unique_side(corrupt, key), key, "left_anti")


def skip_existing(batch: DataFrame, store: DataFrame, path: str = "DicomFilePath", archive: str = "archive",
                  entry_pos: str = "entry_pos") -> DataFrame:
    """Files not stored yet.

    Within an archive the first entry already stored ends the reading of that
    archive, so entries after it are skipped even when they are new.
    """
    known = batch.join(unique_side(store, path), path, "left_semi")
    stop = (known.where(F.col(archive).isNotNull()).groupBy(archive)
            .agg(F.min(entry_pos).alias("_stop")))
    fresh = batch.join(known.where(F.col(archive).isNull()).select(path), path, "left_anti")
    # Files outside archives have no key to join on; kept out of the join they do not all meet in one task.
    entries = fresh.where(F.col(archive).isNotNull()).join(join_side(stop, archive), archive, "left")
    entries = entries.where(F.col("_stop").isNull() | (F.col(entry_pos) < F.col("_stop"))).drop("_stop")
    return entries.unionByName(fresh.where(F.col(archive).isNull()))


def replace_conflicts(store: DataFrame, batch: DataFrame, path: str = "DicomFilePath") -> DataFrame:
    """The store after a forced reload.

    Stored rows sharing a path or an instance UID with the batch give way to it.
    """
    kept = (store.join(unique_side(batch, path), path, "left_anti")
            .join(unique_side(batch, SOP), SOP, "left_anti"))
    return kept.unionByName(batch)


# Columns whose difference alone is no change of the row.
UNCOMPARED = ("MessageGuid",)


@dataclass(frozen=True)
class Merge:
    """What one load does to a live table."""

    inserted: DataFrame
    updated: DataFrame
    archived: DataFrame
    carried: DataFrame
    refused: DataFrame

    @property
    def live(self) -> DataFrame:
        return self.carried.unionByName(self.updated).unionByName(self.inserted)


def merge_live(live: DataFrame, stage: DataFrame, key: str | list[str], run_id: int, loaded_at: Column,
               valid_from: str = "valid_from", run: str = "load_run_id",
               uncompared: tuple[str, ...] = UNCOMPARED, pin_changes: bool = False) -> Merge:
    """Upsert staged rows by primary key.

    A changed row is replaced and its old form archived; a difference only in
    bookkeeping columns changes nothing.  Columns that the stage lacks keep their
    live values on update.  Staged rows without a key, and all rows of a key
    that is staged several times, are ``refused``.  With ``pin_changes`` the changed rows
    are found once and kept, which pays off when all results are written.
    """
    keys = [key] if isinstance(key, str) else list(key)
    content = [c for c in live.columns if c not in (valid_from, run)]
    given = project_common(stage, live.select(*content))
    missing = [c for c in content if c not in given.columns]
    compared = [c for c in given.columns if c not in (*keys, *uncompared)]
    whole = F.lit(True)
    for c in keys:
        whole = whole & F.col(c).isNotNull()
    repeated = given.where(whole).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(*keys)
    staged = given.where(whole).join(join_side(repeated, *keys), keys, "left_anti")
    refused = given.where(whole).join(join_side(repeated, *keys), keys, "left_semi").unionByName(given.where(~whole))
    types = {c: live.schema[c].dataType for c in (valid_from, run)}
    stamp = lambda df: df.withColumn(valid_from, loaded_at.cast(types[valid_from])).withColumn(run, F.lit(run_id).cast(types[run]))
    old = live.select(*[F.col(c) for c in keys], F.struct(*live.columns).alias("_old"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_old.{c}"))
    changed = staged.join(old, keys).where(~same)
    if pin_changes:
        changed = pin(changed)
    new = staged.join(live.select(*keys), keys, "left_anti").select(
        "*", *[F.lit(None).cast(live.schema[c].dataType).alias(c) for c in missing])
    return Merge(
        inserted=stamp(new).select(*live.columns),
        updated=stamp(changed.select(*given.columns, *[F.col(f"_old.{c}").alias(c) for c in missing])).select(*live.columns),
        archived=changed.select("_old.*"),
        carried=live.join(changed.select(*keys), keys, "left_anti"),
        refused=refused,
    )


def reconcile(store: DataFrame, live: DataFrame, key: str = SOP) -> DataFrame:
    """Stored images the relational table does not hold yet."""
    return store.join(unique_side(live, key), key, "left_anti")
