"""Count human verdicts against a frozen list of known rules. Nothing here matches.

Inputs are frames: the key (key_id, type, statement, source, notes), the candidates
(candidate_id, probe, ...), and verdict rows (candidate_id, key_id, verdict, note, row_no),
where row_no gives the order a person wrote them in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ruletrace.functions.cells import strip
from ruletrace.functions.labels import scope_of
from ruletrace.session import settled

VERDICTS = ("MATCH", "NEW", "FALSE")

UNKNOWN_CANDIDATE = "unknown candidate"
BAD_VERDICT = "bad verdict"
MATCH_WITHOUT_KEY = "match without key"
UNKNOWN_KEY = "unknown key"
DISAGREES = "verdicts disagree"

SPREAD = "_spread"


def _text(name: str) -> Column:
    """A cell without any white space around it; null is empty."""
    return F.expr(strip(f"coalesce({name}, '')"))


def spread(*names: str) -> Column:
    """Ids mostly begin alike, so rows are sorted by a hash of them first, which is told apart at a glance."""
    return F.xxhash64(*names).alias(SPREAD)


def _rows(verdicts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Verdict rows without white space around their cells.

    A row without candidate is hashed by its number: it finds no candidate, and such rows do not all meet in one place. They are
    not left out here, for a filter would go to the scan and trim and hash each cell a second time.
    """
    rows = verdicts.select(
        *by, "row_no", _text("candidate_id").alias("candidate_id"), _text("key_id").alias("key_id"),
        F.upper(_text("verdict")).alias("verdict"), _text("note").alias("note"))
    return rows.withColumn(SPREAD, F.when(F.col("candidate_id") == "", F.xxhash64("row_no"))
                           .otherwise(F.xxhash64(*by, "candidate_id")))


def _known_keys(key: DataFrame) -> DataFrame:
    return key.select(F.xxhash64("key_id").alias("_of"), F.col("key_id").alias("_key")).distinct()


def _given(found: DataFrame, verdicts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The rows with a verdict there is, on a known candidate. Others have a problem or none at all, and are not shuffled."""
    return _rows(verdicts, by).filter(F.col("verdict").isin(*VERDICTS)).join(
        found.select(spread(*by, "candidate_id"), *by, "candidate_id"), [SPREAD, *by, "candidate_id"], "left_semi")


def _checked(found: DataFrame, key: DataFrame, verdicts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Verdict rows with the first rule each breaks by itself in ``problem``; read once."""
    known = found.select(spread(*by, "candidate_id"), *by, "candidate_id").distinct().withColumn("known", F.lit(True))
    rows = _rows(verdicts, by).join(known, [SPREAD, *by, "candidate_id"], "left").filter(
        F.when(F.col("known").isNull(), F.col("candidate_id") != "").otherwise(F.col("verdict") != ""))
    return _problems(rows, key).drop("known")


def _problems(rows: DataFrame, key: DataFrame) -> DataFrame:
    """Rows that were looked up (``known``) with the first rule each breaks by itself in ``problem``."""
    verdict, key_id = F.col("verdict"), F.col("key_id")
    # Most rows name no key. They find none, and would all meet in one place.
    named = F.coalesce(F.nullif(key_id, F.lit("")), F.concat(F.lit("\0"), F.col("row_no").cast("string")))
    looked_up = rows.join(_known_keys(key).withColumn("keyed", F.lit(True)),
                          (F.xxhash64(named) == F.col("_of")) & (named == F.col("_key")), "left")
    return (looked_up
            .withColumn("problem",
                        F.when(F.col("known").isNull(), F.lit(UNKNOWN_CANDIDATE))
                        .when(~verdict.isin(*VERDICTS), F.lit(BAD_VERDICT))
                        .when((verdict == "MATCH") & (key_id == ""), F.lit(MATCH_WITHOUT_KEY))
                        .when((key_id != "") & F.col("keyed").isNull(), F.lit(UNKNOWN_KEY)))
            .drop("keyed", "_of", "_key"))


def judged_rows(found: DataFrame, key: DataFrame, verdicts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Verdict rows with the first rule each breaks in ``problem``, null for a sound row.

    A row without candidate or verdict is not a verdict and is left out. A candidate's first
    sound row fixes its verdict, and later rows that differ are problems. ``by`` names columns that tell
    several runs in one frame apart.
    """
    checked, each = _checked(found, key, verdicts, by), [SPREAD, *by, "candidate_id"]
    # The first verdict is an aggregate, so a candidate with very many rows is reduced
    # map-side instead of being sorted in one task.
    first = (checked.filter("problem IS NULL").groupBy(*each)
             .agg(F.min_by("verdict", "row_no").alias("first_verdict")))
    return (checked.join(first, each, "left")
            .withColumn("problem", F.when(
                F.col("problem").isNull() & (F.col("verdict") != F.col("first_verdict")), F.lit(DISAGREES))
                .otherwise(F.col("problem"))).drop(SPREAD))


def tally(found: DataFrame, key: DataFrame, verdicts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The sound verdicts as (by, candidate_id, verdict, key_id), each once, from one look at the verdict rows.

    Equal rows are reduced map-side first. What is left of a candidate is at most one row per verdict and known rule, and
    a window over those finds the verdict that came first.
    """
    each = [SPREAD, *by, "candidate_id"]
    few = (_problems(_given(found, verdicts, by).withColumn("known", F.lit(True)), key).filter("problem IS NULL")
           .groupBy(*each, "verdict", "key_id").agg(F.min("row_no").alias("row_no")))
    first = F.first("verdict").over(Window.partitionBy(*each).orderBy("row_no"))
    return few.withColumn("_first", first).filter("verdict = _first").drop("row_no", "_first", SPREAD)


def _tally(judged: DataFrame) -> DataFrame:
    """Judged rows as a tally; a tally stays what it is."""
    if "problem" not in judged.columns:
        return judged
    return sound(judged).drop("row_no", "note", "problem", "first_verdict").distinct()


def problems(judged: DataFrame) -> DataFrame:
    return judged.filter("problem IS NOT NULL").select(
        "row_no", "candidate_id", "key_id", "verdict", "problem",
        F.when(F.col("problem") == DISAGREES, F.col("first_verdict")).alias("first_verdict"))


def sound(judged: DataFrame) -> DataFrame:
    return judged.filter("problem IS NULL")


def matched_keys(judged: DataFrame) -> DataFrame:
    """(key_id, candidate_id) of every sound match, and what tells runs apart; from judged rows or a tally."""
    return _tally(judged).filter("verdict = 'MATCH'").drop("verdict")


def per_candidate(judged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The verdict of each judged candidate, once, with how many key rows it names."""
    return _tally(judged).groupBy(*by, "candidate_id").agg(
        F.min("verdict").alias("verdict"),
        F.countDistinct(F.when(F.col("key_id") != "", F.col("key_id"))).alias("keys"))


def _hit(name: str) -> Column:
    return F.coalesce(name, F.lit(0)).cast("bigint").alias(name)


def recovery(key: DataFrame, judged: DataFrame, runs: tuple[str, ...] = ()) -> DataFrame:
    """Key rows with their buckets and whether a candidate recovered them, in ``hit`` or in a column for each of the runs."""
    matched = matched_keys(judged)
    sides = [F.max((F.col("run") == r).cast("int")).alias(r) for r in runs] or [F.max(F.lit(1)).alias("hit")]
    hits = matched.groupBy("key_id").agg(*sides)
    blank = lambda c, fill: F.coalesce(F.nullif(c, F.lit("")), F.lit(fill))
    return (key.join(hits, "key_id", "left")
            .select("key_id", "statement",
                    blank(_text("type"), "(untyped)").alias("type"),
                    blank(F.lower(_text("source")), "(unrecorded)").alias("source"),
                    F.expr(scope_of("notes")).alias("scope"), *[_hit(r) for r in runs or ("hit",)]))


def recall_by(recovered: DataFrame, runs: tuple[str, ...] = ()) -> DataFrame:
    """Recovered rows and totals by type, by source, by scope and over all, in one pass over any number of runs."""
    sums = [F.sum(r).alias(f"{r}_recovered") for r in runs] or [F.sum("hit").alias("recovered")]
    return (recovered.groupingSets([["type"], ["source"], ["scope"], []], "type", "source", "scope")
            .agg(*sums, F.count("*").alias("total"),
                 F.grouping("type").alias("_t"), F.grouping("source").alias("_s"),
                 F.grouping("scope").alias("_o"))
            .select(F.when(F.col("_t") == 0, F.lit("type")).when(F.col("_s") == 0, F.lit("source"))
                    .when(F.col("_o") == 0, F.lit("scope")).otherwise(F.lit("all")).alias("bucket"),
                    F.coalesce("type", "source", "scope", F.lit("all")).alias("value"),
                    *[f"{r}_recovered" for r in runs] or ["recovered"], "total"))


def memory_split(recovered: DataFrame) -> DataFrame:
    """Rules recalled unaided, whose source is "head", against rules found in a document."""
    origin = F.when(F.col("source") == "head", F.lit("recalled")).otherwise(F.lit("document"))
    return recovered.groupBy(origin.alias("origin")).agg(
        F.sum("hit").alias("recovered"), F.count("*").alias("total"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _counts_of(name: str) -> list[Column]:
    """Recovered key rows of operating scope, and of any, by the hits in a column."""
    operating = F.col("scope") == "operating"
    return [F.count_if(operating & (F.col(name) == 1)).alias("recall_hit"), F.count_if(operating).alias("recall_total"),
            F.coalesce(F.sum(name), F.lit(0)).alias("recall_all_hit"), F.count("*").alias("key_rows")]


def _verdict_counts() -> list[Column]:
    count = lambda v: F.count_if(F.col("verdict") == v)
    return [count("MATCH").alias("matched"), count("NEW").alias("novelty"), count("FALSE").alias("false"),
            F.count("*").alias("scored")]


def headline(found: DataFrame, key: DataFrame, judged: DataFrame) -> DataFrame:
    """One row of totals. Unjudged candidates count against precision."""
    judged = settled(_tally(judged), "tally")  # read for keys and for candidates
    keys = recovery(key, judged).agg(*_counts_of("hit"))
    verdicts = per_candidate(judged).agg(*_verdict_counts())
    total = found.agg(F.count("*")).scalar()
    both = verdicts.withColumn("_keys", keys.select(F.struct("*")).scalar()).select("*", "_keys.*")
    return (both.withColumn("candidates", total)
            .select("recall_hit", "recall_total",
                    _ratio(F.col("recall_hit"), F.col("recall_total")).alias("recall"),
                    _ratio(F.col("recall_all_hit"), F.col("key_rows")).alias("recall_all"),
                    "matched", "novelty", "false", "scored",
                    (F.col("candidates") - F.col("scored")).alias("unscored"), "candidates",
                    _ratio(F.col("matched") + F.col("novelty"), F.col("candidates")).alias("precision")))


def headline_measures(found: DataFrame, key: DataFrame, judged: DataFrame, runs: tuple[str, ...]) -> DataFrame:
    """recall, precision, novelty and candidates per run, as (run, measure, value); ``found`` and the tally carry ``run``."""
    judged = settled(judged, "tally")
    recovered = recovery(key, judged, runs)
    recall = recovered.agg(*[F.struct(*_counts_of(r)).alias(r) for r in runs])
    recall = recall.select(F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.col(f"{r}.recall_hit"), F.col(f"{r}.recall_total"))
                                               for r in runs])).alias("r")).select("r.*")
    verdicts = per_candidate(judged, ("run",)).groupBy("run").agg(*_verdict_counts())
    produced = found.groupBy("run").agg(F.count("*").alias("candidates"))
    both = recall.join(verdicts, "run", "left").join(produced, "run", "left").fillna(0)
    return both.select(
        "run", _ratio(F.col("recall_hit"), F.col("recall_total")).alias("recall"),
        _ratio(F.col("matched") + F.col("novelty"), F.col("candidates")).alias("precision"),
        F.col("novelty").cast("double").alias("novelty"), F.col("candidates").cast("double").alias("candidates"),
    ).unpivot(["run"], ["recall", "precision", "novelty", "candidates"], "measure", "value")


def noted(found: DataFrame, key: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The notes to list of all candidates judged NEW, as (candidate_id, note, row_no), each once, from one look at the verdict rows.

    Rows on known candidates are written down; of these only rows that name a key are looked up among the known ones. Aggregates,
    which reduce a candidate's rows map-side, find what came first for it and whether it has a note that is not blank.
    """
    note = F.when(F.col("verdict") == "NEW", F.col("note")).otherwise(F.lit(""))
    few = settled(_given(found, verdicts, ()).select(SPREAD, "candidate_id", "verdict", "key_id", note.alias("note"), "row_no"), "few")
    named = few.filter("key_id <> ''").join(
        _known_keys(key), (F.xxhash64("key_id") == F.col("_of")) & (F.col("key_id") == F.col("_key")), "left_semi")
    good = few.filter("key_id = '' AND verdict <> 'MATCH'").unionByName(named)
    first = good.groupBy(SPREAD, "candidate_id").agg(
        F.min_by("verdict", "row_no").alias("_first"), F.bool_or(F.expr("verdict = 'NEW' AND note <> ''")).alias("_worded"))
    new = good.filter("verdict = 'NEW'").groupBy(SPREAD, "candidate_id", "note").agg(F.min("row_no").alias("row_no"))
    return (new.join(first.filter("_first IS NULL OR _first = 'NEW'"), [SPREAD, "candidate_id"])
            .filter("note <> '' OR NOT _worded").select("candidate_id", "note", "row_no"))


def new_finds(found: DataFrame, judged: DataFrame) -> DataFrame:
    """Candidates judged a real rule the key did not hold, with their distinct notes as rows; from judged rows or ``noted``.

    A blank note is listed only for a candidate without any other.
    """
    shown = judged
    if "problem" in judged.columns:
        notes = settled(sound(judged).filter("verdict = 'NEW'").groupBy("candidate_id", "note")
                        .agg(F.min("row_no").alias("row_no")), "notes")  # read three times, and few against the verdict rows
        worded = notes.filter("note <> ''").select("candidate_id").distinct()
        shown = notes.filter("note <> ''").unionByName(
            notes.filter("note = ''").join(worded, "candidate_id", "left_anti"))
    return (found.join(shown, "candidate_id")
            .select("candidate_id", "proposed_type", "statement", "note", "row_no")
            .orderBy("candidate_id", "row_no"))


def unrecovered(key: DataFrame, judged: DataFrame) -> DataFrame:
    """Known rules no candidate matched: the list to ask about."""
    return (recovery(key, judged).filter("hit = 0").select("key_id", "type", "statement")
            .orderBy("key_id"))


def multi_cover(judged: DataFrame) -> DataFrame:
    """Candidates that name more than one key row."""
    return per_candidate(judged).filter("keys > 1").select("candidate_id", "keys")


def covered_keys(judged: DataFrame) -> DataFrame:
    """The key rows each matching candidate covers, one row each."""
    return matched_keys(judged).filter("key_id <> ''").select("key_id", "candidate_id").orderBy("candidate_id", "key_id")


@dataclass(frozen=True)
class Run:
    """One run to compare: its profile, candidates, verdict rows and input volumes."""

    profile: str
    candidates: DataFrame
    verdicts: DataFrame
    volumes: DataFrame      # landing_table, rows
