"""From raw tag sets to the series table, levels, isolation and the live merge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from radloom.functions import paths
from radloom.functions.tags import parse_tags, strip_bulk, tags_to_json
from radloom.operators import identity, load, project, validate
from radloom.schemas import SERIES, SOP, STUDY
from radloom.session import pin
from radloom.template import TemplateTable


@dataclass(frozen=True)
class Ingest:
    good: DataFrame
    bad: DataFrame
    series: DataFrame


def ingest(images: DataFrame, nack_if_any: bool = False, keep: bool = False) -> Ingest:
    """Check identifiers, drop bulk tags, roll up series.

    ``keep`` pins the slimmed images, for when both they and the series are written.
    """
    checked = validate.require_ids(images).withColumn("DirectoryPath", paths.parent_dir(F.col("DicomFilePath")))
    kept = validate.drop_bad(checked, "DirectoryPath", nack_if_any).drop("bad")
    slim = kept.withColumn("DicomDataset", tags_to_json(strip_bulk(parse_tags(F.col("DicomDataset")))))
    slim = pin(slim) if keep else slim
    return Ingest(good=slim, bad=checked.where(F.col("bad").isNotNull()), series=load.series_from_images(slim))


@dataclass(frozen=True)
class Relational:
    unmapped: DataFrame
    isolated: dict[str, DataFrame]
    merges: dict[str, load.Merge]


def load_relational(images: DataFrame, template: dict[str, TemplateTable], mapping: DataFrame,
                    surrogates: DataFrame | None, live: dict[str, DataFrame], run_id: int, loaded_at: Column) -> Relational:
    """Swap identifiers, fill the level tables, isolate, merge.

    ``template`` and ``live`` are keyed ``study``, ``series`` and ``image``.
    """
    batch = load.dedupe_batch(images).withColumn("tags", parse_tags(F.col("DicomDataset")))
    swapped = identity.swap_patient_id(batch, identity.require_unique(mapping), surrogates)
    # Three levels are each read several times from here on; the tag sets are
    # parsed once for all of them.
    flat = pin(project.flatten(swapped, list(template.values()), tags="tags", carry=("fail_reason",)))
    levels = load.split_levels(flat.where(F.col("fail_reason").isNull()), template)
    parted = load.isolate(levels["study"], levels["series"], levels["image"])
    keys = {"study": STUDY, "series": SERIES, "image": SOP}
    merges = {n: load.merge_live(live[n], parted.good[n], k, run_id, loaded_at, pin_changes=True) for n, k in keys.items()}
    return Relational(flat.where(F.col("fail_reason").isNotNull()), parted.bad, merges)
