"""Problem 9: combine sources to target shares of the total size.

Method: capped water-filling. A source's wanted size is its weight's share of the total;
sources that would need more than their cap of repeats are clamped there, their excess is
spread over the rest in proportion to the weights until nothing exceeds a cap, and each
source is then repeated as often as its factor says, whole repeats for all documents and a
seeded fraction of them once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Steps into which the seeded order of a source's documents is counted.
STEPS = 1 << 12


def water_fill(sizes: dict[str, float], weights: dict[str, float], repeats: dict[str, int], total: float) -> dict[str, float]:
    """The size each source contributes. Sources without documents, weight or repeats give 0.

    If all caps together stay under ``total``, every source ends at its cap.
    """
    given = {s: 0.0 for s in weights}
    open_sources = {s for s, w in weights.items() if w > 0 and sizes.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    left = float(total)
    while open_sources and left > 0:
        whole = sum(weights[s] for s in open_sources)
        wanted = {s: left * weights[s] / whole for s in open_sources}
        full = {s for s in open_sources if wanted[s] >= sizes[s] * repeats[s]}
        if not full:
            return given | wanted
        for s in sorted(full):
            given[s] = float(sizes[s] * repeats[s])
        left = float(total) - sum(given.values())
        open_sources -= full
    return given


def plan_mixture(sizes: DataFrame, targets: DataFrame, total: int | None = None, source_limit: int = 100_000) -> DataFrame:
    """(source, weight, target_share, tokens, given, factor) of every target source.

    ``sizes`` is (source, tokens), already summed. Targets are configuration: repeated rows
    of a source count with their largest weight and repeats, null or negative values as 0.
    Only the per-source sums of target sources reach the driver; more than ``source_limit`` of them is an
    error. ``total`` defaults to the tokens of all documents of the target sources.
    """
    spark = sizes.sparkSession
    wanted = targets.where("source is not null").groupBy("source").agg(
        F.greatest(F.coalesce(F.max("weight"), F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("repeats")
    )
    summed = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    rows = wanted.join(summed, "source", "left").select("source", "weight", "repeats", F.coalesce("tokens", F.lit(0)).alias("tokens")).limit(source_limit + 1).collect()
    if len(rows) > source_limit:
        raise ValueError(f"more than {source_limit} target sources")
    if total is None:
        total = sum(r["tokens"] for r in rows)
    given = water_fill({r["source"]: r["tokens"] for r in rows}, {r["source"]: r["weight"] for r in rows}, {r["source"]: r["repeats"] for r in rows}, total)
    whole = sum(r["weight"] for r in rows)
    plan = [
        (r["source"], float(r["weight"]), r["weight"] / whole if whole else 0.0, int(r["tokens"]), float(given[r["source"]]), given[r["source"]] / r["tokens"] if r["tokens"] else 0.0)
        for r in sorted(rows, key=lambda r: r["source"])
    ]
    return spark.createDataFrame(plan, "source string, weight double, target_share double, tokens long, given double, factor double")


def mixture(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1, key: str = "doc_id") -> DataFrame:
    """(key, source, tokens, copies) of every document used at least once.

    ``docs`` is (key, source, tokens). A source with factor f uses all its documents
    floor(f) times; the rest of its size comes from the documents first in a seeded hash
    order, one copy each, until the missing tokens are reached. The order is counted in
    ``STEPS`` steps per source, so no source is sorted in one task: only the step in which
    the limit falls is ordered. Documents with null source are used by no target; documents
    without tokens follow their place in the order. No document exceeds its source's cap.
    """
    docs = docs.select(key, "source", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    plan = plan_mixture(docs, targets, total).where("factor > 0")
    plan = F.broadcast(plan.select("source", F.floor("factor").alias("whole"), (F.col("given") - F.floor("factor") * F.col("tokens")).alias("missing")))
    rank = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    docs = docs.join(plan, "source").withColumn("rank", rank).withColumn("step", F.shiftrightunsigned(F.col("rank"), 64 - 12))
    steps = docs.groupBy("source", "step").agg(F.sum("tokens").alias("step_tokens"), F.first("missing").alias("missing"))
    over = Window.partitionBy("source").orderBy("step")  # at most STEPS rows a source
    steps = steps.select("source", "step", (F.col("missing") - (F.sum("step_tokens").over(over) - F.col("step_tokens"))).alias("room"), "step_tokens")
    docs = docs.join(steps, ["source", "step"])
    inside = docs.where("room <= 0 or room >= step_tokens").withColumn("extra", (F.col("room") >= F.col("step_tokens")) & (F.col("missing") > 0))
    edge = docs.where("room > 0 and room < step_tokens")
    so_far = F.sum("tokens").over(Window.partitionBy("source").orderBy("rank", key).rowsBetween(Window.unboundedPreceding, 0))
    # The last document is taken if at least half of it still fits.
    edge = edge.withColumn("extra", so_far - F.col("tokens") / 2 <= F.col("room"))
    both = inside.unionByName(edge).select(key, "source", "tokens", (F.col("whole") + F.col("extra").cast("int")).cast("int").alias("copies"))
    return both.where("copies > 0")


def shares(mixed: DataFrame, docs: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per target source: weight, target share, tokens it has, tokens used, actual share, most copies of one document."""
    plan = plan_mixture(docs, targets, total)
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"))
    rows = plan.join(F.broadcast(used), "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    everything = F.sum("used").over(Window.partitionBy(F.lit(1)))  # one row a target source
    return rows.select(
        "source", "weight", "target_share", "tokens", F.col("used").alias("used_tokens"),
        F.when(everything > 0, F.col("used") / everything).otherwise(F.lit(0.0)).alias("actual_share"), F.coalesce("most_copies", F.lit(0)).cast("int").alias("most_copies"),
    )
