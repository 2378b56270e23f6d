"""From a cohort list to verdicts, file records and collection records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from radloom.operators import cohort
from radloom.operators.rejectors import ModalityRules, Rejector, select_chain
from radloom.operators.validate import ExtractionOptions
from radloom.schemas import Catalogue
from radloom.session import kept


@dataclass(frozen=True)
class Extraction:
    """One extraction; each result is planned when it is first asked for."""

    ids: DataFrame
    options: ExtractionOptions
    directory: str
    resolver: str
    catalogues: list[Catalogue]
    matched: DataFrame

    @cached_property
    def per_request(self) -> DataFrame:
        return cohort.match_cohort(self.ids, self.options.key, self.catalogues, self.matched)

    @cached_property
    def info(self) -> DataFrame:
        return cohort.job_info(self.ids, self.options.key)

    @cached_property
    def requests(self) -> DataFrame:
        return cohort.chunk_ids(self.ids, self.options.max_ids_per_message)

    @cached_property
    def summary(self) -> DataFrame:
        return cohort.match_summary(self.ids, self.matched)

    @cached_property
    def reasons(self) -> DataFrame:
        return cohort.rejection_reasons(self.matched)

    @cached_property
    def files(self) -> DataFrame:
        return cohort.dispatch(self.matched, self.directory, self.options.identifiable, self.resolver)

    @cached_property
    def collections(self) -> DataFrame:
        return cohort.collection_info(self.ids, self.matched)

    @cached_property
    def messages(self) -> DataFrame:
        return cohort.collection_messages(self.ids, self.matched, self.files)


def plan_extraction(ids: DataFrame, options: ExtractionOptions, modality: str, directory: str,
                    catalogues: list[Catalogue], base: list[Rejector], specific: list[ModalityRules] | None = None,
                    resolver: str = "study_series_sop", keep: bool = False) -> Extraction:
    """Plan one extraction; ``ids`` are ``(pos, key_value)`` rows.

    ``keep`` stores the verdicts, so that the archive is read once however many of
    the results are written.
    """
    options.validate()
    chain = select_chain(modality, base, specific or [], options.no_filters)
    routed = cohort.route_catalogues(catalogues, modality, options.key)
    matched = cohort.match_images(ids, options.key, routed, chain)
    return Extraction(ids, options, directory, resolver, routed, kept(matched) if keep else matched)
