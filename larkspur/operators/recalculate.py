"""Metrics from stored definitions, and their recalculation after deletions and late rows, for affected groups only.

A definition is the JSON text that a run's manifest keeps.  ``values`` makes one plan of it; ``affected`` tells
which of its groups some records belong to; ``superseding`` computes these groups again and appends runs that
supersede theirs.  Groups are rows and definitions are few, so a plan serves all runs of a definition.
"""

from __future__ import annotations

import dataclasses
import json
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import canon, instants, money

from . import metrics
from .metrics import Definition

KEYS = ["tenant_id", "app_id", "installation_id"]
COHORT = ("campaign_id", "network", "country", "cohort_date", "attribution_status")
#: Definitions that one call computes; each has a plan of its own.
MOST_DEFINITIONS = 1000


@dataclass(frozen=True)
class Inputs:
    """The records that metrics read, one table a kind; each has record_id and received_at.

    installs: KEYS, installed_ms and cohort columns; revenue: KEYS, occurred_ms, value (in the target unit, null without a
    rate); sessions: KEYS, occurred_ms; events: event_name, occurred_ms and their own grouping columns; costs:
    grouping columns and cost.
    """

    installs: DataFrame
    revenue: DataFrame
    sessions: DataFrame
    events: DataFrame
    costs: DataFrame

    def without(self, records: DataFrame) -> Inputs:
        """The inputs after a deletion of records (record_id)."""
        gone = records.select("record_id").distinct()
        return Inputs(*[getattr(self, f.name).join(gone, "record_id", "left_anti") for f in dataclasses.fields(self)])

    def until(self, watermark: str) -> Inputs:
        return Inputs(*[getattr(self, f.name).where(F.col("received_at") <= F.lit(watermark)) for f in dataclasses.fields(self)])

    def received_after(self, watermark: str) -> DataFrame:
        """record_id of the rows that came after a watermark."""
        return reduce(DataFrame.unionByName, [getattr(self, f.name).where(F.col("received_at") > F.lit(watermark)).select("record_id") for f in dataclasses.fields(self)])


def stored(definition: Definition) -> str:
    """The JSON text of a definition as manifests keep it."""
    return json.dumps(dataclasses.asdict(definition), sort_keys=True, separators=(",", ":"))


def loaded(text: str) -> Definition:
    """The definition of a JSON text; unknown fields and unsound values raise."""
    fields = json.loads(text)
    unknown = set(fields) - {f.name for f in dataclasses.fields(Definition)}
    if unknown:
        raise ValueError(f"unknown fields of a metric definition: {sorted(unknown)}")
    out = Definition(**{k: tuple(v) if isinstance(v, list) else v for k, v in fields.items()})
    out.check()
    return out


def definitions(manifests: DataFrame) -> list[Definition]:
    """The distinct definitions of manifests (``definition``, a JSON text)."""
    found = manifests.select("definition").distinct().limit(MOST_DEFINITIONS + 1).collect()
    if len(found) > MOST_DEFINITIONS:
        raise ValueError("too many metric definitions for one recalculation")
    return sorted((loaded(r[0]) for r in found), key=lambda d: (d.metric_name, stored(d)))


def groups_of(definition: Definition) -> list[str]:
    """The scope and grouping columns of a definition's values."""
    return ["tenant_id", "app_id", *definition.grouping]


def _day(rows: DataFrame, zone: str) -> DataFrame:
    return rows.withColumn("metric_date", instants.day_in(F.timestamp_millis("occurred_ms"), zone).cast("string"))


def values(definition: Definition, inputs: Inputs, wanted: DataFrame | None = None) -> DataFrame:
    """(groups, value as units, undefined_reason) of a definition; of the wanted groups only, if they are given.

    The wanted groups cut the installs (or events) before anything is joined with them.
    """
    definition.check()
    groups, kind, d = groups_of(definition), definition.calculation, definition.day
    pick = lambda rows: rows if wanted is None else rows.join(wanted, groups, "left_semi")
    if kind == "event_count":
        rows = pick(_day(inputs.events.where(F.col("event_name").isin(*definition.event_names)), definition.zone))
        return rows.groupBy(*groups).agg(F.count("*").cast(money.UNITS).alias("value")).withColumn("undefined_reason", F.lit(None).cast("string"))
    cohort = metrics.net(pick(inputs.installs), definition.fraud_policy)
    if kind == "cohort_size":
        out = cohort.groupBy(*groups).agg(F.count_distinct(*KEYS).cast(money.UNITS).alias("value"))
        return out.withColumn("undefined_reason", F.lit(None).cast("string"))
    if kind == "active_installations_over_cohort":
        out = metrics.retained(cohort, inputs.sessions, groups, [d], KEYS).withColumnRenamed(f"active_d{d}", "_top")
        return _over(out, "cohort_size", definition, groups)
    if definition.window == "calendar_day":
        sums = metrics.calendar_revenue(cohort, inputs.revenue, groups, definition.zone, KEYS, d).withColumnRenamed("revenue", "_top")
        out = cohort.groupBy(*groups).agg(F.count_distinct(*KEYS).alias("cohort_size")).join(sums, groups, "left").withColumn("_top", F.coalesce("_top", F.lit(0)))
    else:
        out = metrics.cohort_revenue(cohort, inputs.revenue, groups, [d], KEYS).withColumnRenamed(f"revenue_d{d}", "_top")
    if kind == "revenue_sum":
        return out.select(*groups, F.col("_top").cast(money.UNITS).alias("value"), F.lit(None).cast("string").alias("undefined_reason"))
    if kind == "revenue_over_cost":
        cost = inputs.costs.groupBy(*groups).agg(F.sum("cost").alias("cost"))
        return _over(out.join(cost, groups, "left"), "cost", definition, groups)
    return _over(out, "cohort_size", definition, groups)


def _over(rows: DataFrame, bottom: str, definition: Definition, groups: list[str]) -> DataFrame:
    value = metrics.ratio(F.col("_top"), F.col(bottom), definition.ratio_scale)
    return rows.select(*groups, F.when(F.coalesce(F.col(bottom), F.lit(0)) != 0, value).cast(money.UNITS).alias("value"), metrics.undefined_reason(definition.calculation, F.col(bottom)).alias("undefined_reason"))


def affected(definition: Definition, inputs: Inputs, records: DataFrame) -> DataFrame:
    """The groups of a definition that the given records (record_id) have a part in, by the inputs that have them."""
    groups, hit = groups_of(definition), records.select("record_id").distinct()
    mine = lambda rows: rows.join(hit, "record_id", "left_semi")
    if definition.calculation == "event_count":
        return mine(_day(inputs.events.where(F.col("event_name").isin(*definition.event_names)), definition.zone)).select(*groups).distinct()
    found = [mine(inputs.installs).select(*groups)]
    facts = {"active_installations_over_cohort": inputs.sessions, "cohort_size": None}.get(definition.calculation, inputs.revenue)
    if facts is not None:
        found.append(inputs.installs.join(mine(facts).select(*KEYS).distinct(), KEYS, "left_semi").select(*groups))
    if definition.calculation == "revenue_over_cost":
        found.append(mine(inputs.costs).select(*groups))
    return reduce(DataFrame.unionByName, found).distinct()


def first_runs(manifests_of: list[Definition], inputs: Inputs, prefix: str, computed_at: str) -> DataFrame:
    """Runs of definitions over all their groups, with the definition that a manifest keeps."""
    return reduce(DataFrame.unionByName, [_runs(d, values(d, inputs), prefix, computed_at) for d in manifests_of])


def _runs(definition: Definition, rows: DataFrame, prefix: str | Column, computed_at: str | Column) -> DataFrame:
    groups = groups_of(definition)
    dimensions = F.to_json(F.struct(*[F.col(g).cast("string").alias(g) for g in sorted(groups)]), {"ignoreNullFields": "false"})
    out = rows.select("tenant_id", "app_id", dimensions.alias("grouping"), "value", "undefined_reason", F.lit(prefix).alias("prefix"), F.lit(computed_at).alias("computed_at"))
    seed = F.concat_ws("\u0000", "prefix", F.lit(stored(definition)), "grouping")
    return out.select(
        F.concat("prefix", F.lit(":"), F.substring(F.sha2(seed, 256), 1, 48)).alias("metric_run_id"), "tenant_id", "app_id", F.lit(definition.metric_name).alias("metric_name"), F.lit(stored(definition)).alias("definition"), "grouping",
        F.when(F.col("value").isNull(), "undefined").otherwise("present").alias("value_state"), "value", "undefined_reason", "computed_at", F.lit("current").alias("data_freshness"), F.lit("reproducible").alias("reproducibility_status"), F.lit(None).cast("string").alias("supersedes_metric_run_id"),
    )


def _filled(definition: Definition, wanted: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each wanted group; one that has no value is undefined."""
    same = [F.col(f"w.{g}").eqNullSafe(F.col(f"f.{g}")) for g in groups_of(definition)]
    gone = F.lit(None if definition.calculation == "event_count" else "empty_cohort").cast("string")
    full = wanted.alias("w").join(found.withColumn("_met", F.lit(True)).alias("f"), same, "left")
    return full.select("w.*", "f.value", F.when(F.col("f._met"), F.col("f.undefined_reason")).otherwise(gone).alias("undefined_reason"))


def file_runs(config: dict, known: list[Definition], inputs: Inputs) -> DataFrame:
    """The runs that a definitions file (``metrics.definition_file``) asks for: one for each evaluation and metric.

    A run is of the one group that its evaluation names, in the file's scope, over what was received up to
    the watermark; only these groups' installs or events are joined, and evaluations that differ in their
    groups alone share a plan.  The file's own definitions take precedence over known ones.  Counts of events
    are of the ``metric_date``, which is the cohort's date unless an evaluation has it.  Metrics that are not
    defined and grouping dimensions that are none raise before any job.
    """
    by_name = {d.metric_name: d for d in [*known, *(loaded(json.dumps(x)) for x in config["metric_definitions"])]}
    asked = defaultdict(list)
    for e in config["evaluations"]:
        for name in e["metric_names"]:
            if name not in by_name:
                raise ValueError(f"metric is not defined: {name}")
            group = {k: v for k, v in e["grouping"].items() if v is not None}
            if by_name[name].calculation == "event_count":
                day = group.pop("cohort_date")
                group.setdefault("metric_date", day)
            d = dataclasses.replace(by_name[name], grouping=tuple(sorted(group)))
            d.check()
            asked[d, e["input_received_at_watermark"]].append((config["tenant_id"], config["app_id"], *(group[k] for k in d.grouping), e["metric_run_id_prefix"], e["computed_at"]))
    out = []
    for (d, watermark), places in asked.items():
        wanted = inputs.installs.sparkSession.createDataFrame(places, ", ".join(f"`{k}` string" for k in (*groups_of(d), "_prefix", "_at")))
        found = values(d, inputs.until(watermark), wanted.select(*groups_of(d)))
        out.append(_runs(d, _filled(d, wanted, found), F.col("_prefix"), F.col("_at")))
    return reduce(DataFrame.unionByName, out)


def superseding(runs: DataFrame, before: Inputs, after: Inputs, records: DataFrame, cause: str, computed_at: str, status: str = "redaction_affected") -> DataFrame:
    """Runs that supersede the live runs of the groups which records (deleted, or late) have a part in.

    ``before`` are the inputs of the stored runs, ``after`` those of now; records are in either.  A group that has no
    installs or events any more gets an undefined run.  Ids follow from the cause and the run that is superseded, so
    the same recalculation again gives the same rows.  Late rows can make groups that have no run: these get their first.
    """
    from .ledger import not_superseded

    live = not_superseded(runs, "metric_run_id", "supersedes_metric_run_id").select("tenant_id", "app_id", "definition", "grouping", F.col("metric_run_id").alias("_old"))
    out = []
    for d in definitions(runs):
        wanted = affected(d, before, records).unionByName(affected(d, after, records)).distinct()
        fresh = values(d, after, wanted)
        out.append(_runs(d, _filled(d, wanted, fresh), cause, computed_at))
    new = reduce(DataFrame.unionByName, out).withColumn("data_freshness", F.lit("recalculated")).withColumn("reproducibility_status", F.lit(status))
    met = new.join(live, ["tenant_id", "app_id", "definition", "grouping"], "left").withColumn("supersedes_metric_run_id", F.col("_old"))
    named = F.concat(F.lit(f"{cause}:"), F.substring(canon.digest_array([F.lit(cause), F.col("_old")]), 1, 48))
    return met.withColumn("metric_run_id", F.when(F.col("_old").isNotNull(), named).otherwise(F.col("metric_run_id"))).select(*runs.columns)
