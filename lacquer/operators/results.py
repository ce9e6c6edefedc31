"""The result structs and their merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.policy import Policy

COMPLETE, TRUNCATED, EXHAUSTED = 0, 1, 2
# The bits of `reasons`.
REASONS = (
    "input_limit_reached", "output_limit_reached", "traversal_limit_reached", "depth_limit_reached", "source_truncated", "invalid_json",
    "invalid_uri", "invalid_content_type", "unsupported_content_type", "invalid_form", "invalid_multipart",
)
BIT = {name: 1 << k for k, name in enumerate(REASONS)}
USAGE = "struct<presented:bigint,inspected:bigint,output:bigint,nodes:bigint,items:bigint,depth:int,omitted:bigint>"
RESULT = f"struct<text:string,completion:tinyint,reasons:int,disabled:boolean,usage:{USAGE}>"
INSPECTION = f"struct<ok:boolean,max_sensitivity:tinyint,disabled:boolean,reasons:int,usage:{USAGE}>"


def usage(presented: Column | int = 0, inspected: Column | int | None = None, output: Column | int = 0, nodes: Column | int = 1, items: Column | int = 0, depth: Column | int = 1, omitted: Column | int = 0) -> Column:
    inspected = presented if inspected is None else inspected
    values = {"presented": presented, "inspected": inspected, "output": output, "nodes": nodes, "items": items, "depth": depth, "omitted": omitted}
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items())).cast(USAGE)


def result(text: Column, policy: Policy, completion: Column | int = COMPLETE, reasons: Column | int = 0, used: Column | None = None) -> Column:
    """A result struct; null if the text is null."""
    lit = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    used = used if used is not None else usage(output=F.octet_length(text))
    out = F.struct(text.alias("text"), lit(completion, "tinyint").alias("completion"), lit(reasons, "int").alias("reasons"), F.lit(policy.disabled).alias("disabled"), used.alias("usage")).cast(RESULT)
    return F.when(text.isNotNull(), out)


def inspection(level: Column, policy: Policy, ok: Column | None = None, reasons: Column | int = 0, used: Column | None = None) -> Column:
    """An inspection struct: max_sensitivity only if it is ok, and null for level 0."""
    ok = F.lit(True) if ok is None else ok
    reasons = reasons if isinstance(reasons, Column) else F.lit(reasons)
    return F.struct(ok.alias("ok"), F.when(ok & (level > 0), level).cast("tinyint").alias("max_sensitivity"), F.lit(policy.disabled).alias("disabled"), reasons.cast("int").alias("reasons"), (used if used is not None else usage()).alias("usage")).cast(INSPECTION)


def merge_summaries(r: str) -> list[Column]:
    """Aggregates that merge the result column named r: worst completion, all reasons, summed usage, deepest depth; an unknown omission hides the sum."""
    u = F.col(f"{r}.usage")
    return [
        F.max(F.col(f"{r}.completion")).alias("completion"),
        F.coalesce(F.bit_or(F.col(f"{r}.reasons")), F.lit(0)).alias("reasons"),
        *(F.sum(u[k]).alias(k) for k in ("presented", "inspected", "output", "nodes", "items")),
        F.max(u["depth"]).alias("depth"),
        F.when(F.count(r) == F.count(u["omitted"]), F.sum(u["omitted"])).alias("omitted"),
    ]


PARTIAL = ("presented", "inspected", "output", "nodes", "items")


def partial_summaries(df: DataFrame, keys: list[str], r: str) -> DataFrame:
    """A row per group that can be stored and merged with others: what merge_summaries gives, with the count of results and of unknown omissions."""
    unknown = F.count_if(F.col(r).isNotNull() & F.col(f"{r}.usage.omitted").isNull()).alias("n_unknown")
    known = F.coalesce(F.sum(F.col(f"{r}.usage.omitted")), F.lit(0)).alias("known_omitted")
    return df.groupBy(*keys).agg(F.count(r).alias("n_results"), *merge_summaries(r)[:-1], known, unknown)


def merge_partials(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The summaries of all results behind partial ones, in whatever parts they were taken: one unknown omission hides the sum for good."""
    omitted = F.when(F.sum("n_unknown") == 0, F.sum("known_omitted")).alias("omitted")
    return parts.groupBy(*keys).agg(F.sum("n_results").alias("n_results"), F.max("completion").alias("completion"), F.bit_or("reasons").alias("reasons"), *(F.sum(c).alias(c) for c in PARTIAL), F.max("depth").alias("depth"), omitted)


def reason_names(reasons: Column) -> Column:
    return F.filter(F.array(*(F.when(reasons.bitwiseAND(F.lit(BIT[n])) != 0, F.lit(n)) for n in REASONS)), lambda x: x.isNotNull())
