"""From pools to nested training tiers, and from tiers to a materialised corpus."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentcorpus.operators import align, audit, filters, records, sample, setops
from agentcorpus.session import cut

LABEL = re.compile("[a-z0-9][a-z0-9_]*")


@dataclass(frozen=True)
class TaskSpec:
    sizes: Mapping[str, int]
    temperature: float = 0.5
    max_domain_share: float = 0.02
    max_per_unit: int = 1
    category_weights: Mapping[str, float] = field(default_factory=dict)
    required_categories: Sequence[str] = ()
    minimum_category_share: float = 0.0


def check_specs(tasks: Mapping[str, TaskSpec]) -> list[str]:
    """Tier order shared by all tasks; raises on an unusable specification."""
    if not tasks:
        raise ValueError("at least one task is required")
    order: list[str] | None = None
    for task, spec in tasks.items():
        counts = list(spec.sizes.values())
        for label in (task, *spec.sizes):
            if not LABEL.fullmatch(label):
                raise ValueError(f"unsafe label: {label}")
        if not counts or counts[0] <= 0 or any(b <= a for a, b in zip(counts, counts[1:])):
            raise ValueError(f"tier sizes of {task} must be positive and strictly increasing")
        if order is not None and list(spec.sizes) != order:
            raise ValueError("every task must define the same ordered tiers")
        order = list(spec.sizes)
        if not 0 <= spec.temperature <= 1:
            raise ValueError(f"temperature of {task} must be in [0, 1]")
        if not 0 < spec.max_domain_share <= 1:
            raise ValueError(f"domain share of {task} must be in (0, 1]")
        if spec.max_per_unit <= 0:
            raise ValueError(f"unit cap of {task} must be positive")
    return order


NARROW = ("id", "suite", "task", "domain", "website_category", "trajectory_id", "image")


def _stored(side: DataFrame) -> DataFrame:
    """The columns that gates and tiers read, with canonical domains."""
    named = records.canonicalize_domain_column(side)
    return cut(named, *[name for name in NARROW if name in named.columns])


def build_ladder(
    training: DataFrame,
    suites: DataFrame,
    tasks: Mapping[str, TaskSpec],
    seed: int,
    required_disjoint: Mapping[str, Sequence[str]],
    combined_share: float = 1.0,
    reject_unknown: bool = True,
) -> dict[str, DataFrame]:
    """Leakage gates, then nested tiers per task and combined.

    ``suites`` holds all evaluation rows with a ``suite`` column.
    """
    order = check_specs(tasks)
    # both sides are read by every gate and tier: their narrow columns are stored, and the keys they share
    training, suites = (_stored(side) for side in (training, suites))
    shared = cut(setops.shared_keys(training, suites))
    align.require_empty(setops.unique_ids(training), "training ids are not unique")
    overlap = setops.leakage_preview(training, suites, shared=shared).where("kind <> 'known_domain'")
    align.require_empty(overlap, "training and evaluation share rows")
    align.require_empty(
        setops.required_disjoint(training, suites, required_disjoint, shared), "suite overlap"
    )
    if reject_unknown:
        filters.reject_unknown_domains(training)
        filters.reject_unknown_domains(suites)
    candidates = records.with_unit(training)
    members, audits = [], []
    for index, (task, spec) in enumerate(tasks.items()):
        tiers = sample.nested_tiers(
            candidates.where(F.col("task") == task), spec.sizes, seed + index,
            spec.temperature, spec.max_domain_share, spec.max_per_unit, spec.category_weights,
            spec.required_categories, spec.minimum_category_share,
        )
        held = cut(
            sample.tier_membership(tiers, order).withColumn("task", F.lit(task))
        )
        align.require_empty(setops.nested_check(held, order), f"{task} tiers are not nested")
        audits.append(
            sample.tier_audit(
                held, spec.max_domain_share, spec.required_categories, spec.minimum_category_share
            ).withColumn("task", F.lit(task))
        )
        members.append(held)
    combined = reduce(DataFrame.unionByName, members)
    report = reduce(DataFrame.unionByName, audits)
    align.require_empty(report.where("not cap_ok or not floor_ok"), "a tier breaks its limits")
    whole = setops.combined_tier(combined, seed, combined_share)
    align.require_empty(whole.where("not cap_ok"), "a combined tier exceeds its domain cap")
    return {
        "members": setops.combined_order(combined, seed),
        "tier_audit": report,
        "combined_audit": whole,
        "leakage": setops.leakage_audit(training, suites, shared),
    }


def materialize(
    tier: DataFrame, suites: Sequence[DataFrame], checkpoints: DataFrame
) -> dict[str, DataFrame]:
    """Join the largest tier and the suites to the image index; every image must be there."""
    align.require_empty(align.image_index_conflicts(checkpoints), "conflicting images")
    index = align.image_index_merge(checkpoints)
    chosen = setops.selected_records([tier, *suites])
    located = chosen.withColumn("locator_id", records.locator_id(F.col("image_locator")))
    align.require_empty(align.unmaterialized(located, index), "images are missing")
    flat = located.select("locator_id", "image_locator.*")
    return {
        "records": align.materialize_manifest(located, index),
        "groups": align.locator_group_rows(flat),
        "summary": audit.materialization_summary(flat, index),
    }
