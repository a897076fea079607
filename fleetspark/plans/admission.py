"""Admission report: all rules on all changed installations at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetspark.operators import storage


def admission_report(
    installations: DataFrame,
    old_clusters: DataFrame,
    new_clusters: DataFrame,
    old_claims: DataFrame,
    new_claims: DataFrame,
    strict: bool = False,
) -> DataFrame:
    """Accepted or not, with the errors of each installation.

    ``installations`` is ``(inst, data_claim, log_claim)``.  ``strict`` also
    compares the sizes of old and new claim templates.
    """
    errors = storage.storage_floor(installations, new_claims).unionByName(
        storage.no_scale_in(old_clusters, new_clusters, new_claims)
    )
    if strict:
        errors = errors.unionByName(storage.no_claim_shrink(old_claims, new_claims))
    return storage.collect_errors(installations, errors)
