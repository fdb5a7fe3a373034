"""What survives when the data gets thinner: a richer run against a leaner one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ruletrace.plans import scoring
from ruletrace.plans.scoring import Run
from ruletrace.session import settled


def same_profile(rich: Run, lean: Run) -> bool:
    """A comparison of two runs of one profile says nothing about thinner data."""
    return rich.profile == lean.profile


def _beside(rich: DataFrame, lean: DataFrame, on: list[str]) -> DataFrame:
    """Two count frames side by side; what one lacks counts as zero."""
    values = [c for c in rich.columns if c not in on]
    left = rich.select(*on, *[F.col(c).alias(f"rich_{c}") for c in values])
    right = lean.select(*on, *[F.col(c).alias(f"lean_{c}") for c in values])
    zero = {f"{side}_{c}": F.coalesce(f"{side}_{c}", F.lit(0).cast("bigint"))
            for side in ("rich", "lean") for c in values}
    return left.join(right, on, "full").withColumns(zero)


def volume_delta(rich: Run, lean: Run) -> DataFrame:
    return _beside(rich.volumes, lean.volumes, ["landing_table"])


def probe_delta(rich: Run, lean: Run) -> DataFrame:
    counts = [r.candidates.groupBy("probe").agg(F.count("*").alias("candidates")) for r in (rich, lean)]
    return _beside(*counts, ["probe"])


RUNS = ("rich", "lean")


def _both(rich: DataFrame, lean: DataFrame) -> DataFrame:
    """Rows of both runs in one frame, told apart by ``run``."""
    return rich.withColumn("run", F.lit("rich")).unionByName(lean.withColumn("run", F.lit("lean")))


def _found(rich: Run, lean: Run) -> DataFrame:
    return _both(*[r.candidates.select("candidate_id") for r in (rich, lean)])


def _judged(rich: Run, lean: Run, key: DataFrame) -> DataFrame:
    """The verdicts of both runs judged together: each run's sheet is read once."""
    columns = ["row_no", "candidate_id", "key_id", "verdict", "note"]
    given = _both(*[r.verdicts.select(*columns) for r in (rich, lean)])
    return scoring.tally(_found(rich, lean), key, given, ("run",))


def headline_delta(rich: Run, lean: Run, key: DataFrame) -> DataFrame:
    """recall, precision, novelty and candidates of both runs, and the change, as rows."""
    measures = scoring.headline_measures(_found(rich, lean), key, _judged(rich, lean, key), RUNS)
    return (measures.groupBy("measure").agg(*[F.max(F.when(F.col("run") == r, F.col("value"))).alias(r) for r in RUNS])
            .withColumn("change", F.col("lean") - F.col("rich")))


def survival(rich: Run, lean: Run, key: DataFrame) -> DataFrame:
    """Per constraint type and per source, whether what the richer run found is still found."""
    both = (scoring.recall_by(scoring.recovery(key, _judged(rich, lean, key), RUNS), RUNS)
            .filter("bucket IN ('type', 'source')"))
    a, b = F.col("rich_recovered"), F.col("lean_recovered")
    verdict = (F.when((a > 0) & (b >= a), F.lit("yes")).when((a > 0) & (b > 0), F.lit("partly"))
               .when(a > 0, F.lit("lost entirely")).when(b > 0, F.lit("only in the leaner run"))
               .otherwise(F.lit("neither run found it")))
    return both.select("bucket", "value", "rich_recovered", "lean_recovered", "total", verdict.alias("survives"))


def moved_keys(rich: Run, lean: Run, key: DataFrame) -> DataFrame:
    """Key rows recovered by one run only, one row per candidate that found them."""
    matched = settled(scoring.matched_keys(_judged(rich, lean, key)), "matched")
    once = (matched.groupBy("key_id").agg(F.min("run").alias("_run"), F.max("run").alias("_other"))
            .filter("_run = _other").select("key_id"))
    moved = F.when(F.col("run") == "rich", F.lit("lost")).otherwise(F.lit("gained"))
    rows = matched.join(once, "key_id").select("key_id", F.col("candidate_id").alias("found_by"), moved.alias("moved"))
    return key.select("key_id", "type", "statement").join(rows, "key_id")


def one_sided_candidates(rich: Run, lean: Run) -> DataFrame:
    """Candidate ids only one of the runs produced, from one shuffle of the ids of both.

    Ids compress so well that a partition of few bytes holds very many of them. With their hash beside them they do not,
    so adaptive execution, which goes by bytes, leaves a task no more than it can hold.
    """
    sides = (_found(rich, lean).groupBy(F.xxhash64("candidate_id").alias("_spread"), "candidate_id")
             .agg(F.min("run").alias("only_in"), F.max("run").alias("_other")))
    return sides.filter("only_in = _other").select("candidate_id", "only_in")
