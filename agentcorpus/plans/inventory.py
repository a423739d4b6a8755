"""From candidate records to frozen pools, suites, catalog and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentcorpus.functions import hashing
from agentcorpus.operators import align, audit, filters, records, sample, split, website
from agentcorpus.session import cut


@dataclass(frozen=True)
class InventorySpec:
    seed: int
    partitions: Mapping[str, int]
    iid_percent: int
    evaluation_targets: Mapping[str, Mapping[str, int]]
    evaluation_sampling: Mapping = field(default_factory=dict)
    excluded_domains: Sequence[str] = ()
    website_rules: Sequence[tuple[str, str]] = ()


def freeze(candidates: DataFrame, spec: InventorySpec) -> dict[str, DataFrame]:
    """Annotate, exclude, assign and sample.

    The assigned table is stored once; the catalog, the audits, the pools and every suite read that
    copy.  Returns named tables; writing them is up to the caller.
    """
    kept, dropped = filters.exclude_domains(records.with_unit(candidates), spec.excluded_domains)
    # annotated last, so that only the given columns are shuffled by unit
    placed = split.assign_destination(kept, spec.seed, spec.partitions, spec.iid_percent)
    assigned = cut(records.annotate_website(placed, spec.website_rules))
    align.require_empty(split.destination_conflicts(assigned), "destination conflict")
    tables = {
        "assigned": assigned,
        "excluded_domains": dropped,
        "excluded_records": split.excluded_records_by_task(assigned),
        "unit_audit": split.unit_split_audit(
            assigned.drop("destination", "cross_partition"), spec.seed, spec.partitions,
            spec.iid_percent,
        ),
        "catalog": website.website_catalog(assigned),
        "catalog_dimensions": website.catalog_dimensions(assigned),
    }
    for task in ("qa", "grounding", "action"):
        pool = assigned.where((F.col("destination") == "train") & (F.col("task") == task))
        tables[f"train_{task}"] = pool
        tables[f"train_{task}_audit"] = audit.audit(pool)
    for number, (suite, targets) in enumerate(spec.evaluation_targets.items()):
        parts = []
        for index, (task, count) in enumerate(targets.items()):
            pool = assigned.where((F.col("destination") == suite) & (F.col("task") == task))
            picked = sample.suite_sample(
                pool, suite, task, count, spec.seed + number * 10 + index,
                spec.evaluation_sampling,
            )
            parts.append(pool.join(sample.require_rows(picked, count, f"{suite}/{task}"), "id"))
        if parts:
            chosen = parts[0]
            for part in parts[1:]:
                chosen = chosen.unionByName(part, allowMissingColumns=True)
            order = hashing.stable_key(spec.seed, suite, F.col("id"))
            tables[f"suite_{suite}"] = chosen.withColumn("order_hash", order)
            tables[f"suite_{suite}_audit"] = audit.audit(chosen)
    return tables
