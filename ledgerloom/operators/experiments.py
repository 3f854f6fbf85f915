"""Analysis of paired, blinded experiments: ratings, adjudication, agreement, effects, resampling."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.keys import hmac_sha256
from ledgerloom.functions.text import word_count
from ledgerloom.operators.links import running_total
from ledgerloom.operators.scratch import Scratch


def resolved_ratings(ratings: DataFrame) -> DataFrame:
    """(blind_id, dimension, rating, adjudicated) of ratings (blind_id, dimension, rater_a, rater_b, adjudicator): the mean of two raters, the median
    of three where they are two or more apart. Nulls in a rater's column give a null rating."""
    apart = F.abs(F.col("rater_a") - F.col("rater_b")) >= 2
    median = F.element_at(F.sort_array(F.array("rater_a", "rater_b", "adjudicator")), 2).cast("double")
    return ratings.select("blind_id", "dimension", F.when(apart, median).otherwise((F.col("rater_a") + F.col("rater_b")) / 2.0).alias("rating"), apart.alias("adjudicated"))


def adjudication_targets(ratings: DataFrame) -> DataFrame:
    """(blind_id, dimensions) that need a third rater, dimensions joined by `;`."""
    return (
        ratings.where(F.abs(F.col("rater_a") - F.col("rater_b")) >= 2).groupBy("blind_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_set("dimension")), lambda d: d.cast("string")), ";").alias("dimensions"))  # one trial's dimensions
    )


def agreement(ratings: DataFrame) -> DataFrame:
    """(dimension, n, same, near): how many ratings are equal, and how many at most one apart."""
    gap = F.abs(F.col("rater_a") - F.col("rater_b"))
    return ratings.groupBy("dimension").agg(F.count("*").alias("n"), F.count_if(gap == 0).alias("same"), F.count_if(gap <= 1).alias("near"))


def critical_majority(votes: DataFrame) -> DataFrame:
    """(blind_id, n, votes, critical): a strict majority of votes (blind_id, vote)."""
    by = votes.groupBy("blind_id").agg(F.count("*").alias("n"), F.count_if("vote").alias("votes"))
    return by.withColumn("critical", F.col("votes") >= F.floor(F.col("n") / 2) + 1)


def condition_summary(totals: DataFrame) -> DataFrame:
    """(condition, n, mean, median) of totals (condition, total)."""
    return totals.groupBy("condition").agg(F.count("*").alias("n"), F.avg("total").alias("mean"), F.median("total").alias("median"))


def paired_effects(totals: DataFrame, first: str, second: str) -> DataFrame:
    """(pair_id, case_id, lift) of totals (pair_id, case_id, condition, total): second minus first, null where a side is missing."""
    value = lambda name: F.sum(F.when(F.col("condition") == name, F.col("total")))
    return totals.groupBy("pair_id", "case_id").agg((value(second) - value(first)).alias("lift"))


def effect_summary(effects: DataFrame) -> DataFrame:
    """(case_id, pairs, wins, ties, mean_lift)."""
    own = effects.where(F.col("lift").isNotNull())
    return own.groupBy("case_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("lift") > 0).alias("wins"), F.count_if(F.col("lift") == 0).alias("ties"), F.avg("lift").alias("mean_lift"))


def bootstrap_interval(spark: SparkSession, cases: dict[str, list[float]], draws: int = 10_000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(low, high) of the mean of all lifts drawn in two-stage resampling: cases, then pairs within each.

    The lifts of an experiment are few; its draws are spread over tasks, each with a generator of its own, seeded by its number."""
    names = sorted(cases)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in batch["id"]:
                rng = random.Random(seed * 1_000_003 + int(k))
                picked = rng.choices(names, k=len(names))
                drawn = [x for c in picked for x in rng.choices(cases[c], k=len(cases[c]))]
                out.append(sum(drawn) / len(drawn))
            yield pd.DataFrame({"mean": out})

    if not names:
        return spark.createDataFrame([], "low double, high double")
    means = spark.range(draws).mapInPandas(run, "mean double")
    tail = (1 - level) / 2
    return means.agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))


def bootstrap_interval_of_effects(effects: DataFrame, draws: int = 10_000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(low, high) as of bootstrap_interval(), from effects (case_id, lift) of any number of pairs; null lifts don't count.

    Pairs drawn from a case are multinomial counts over the histogram of its lifts, so every pair takes part and no list of pairs is
    held: each task has the histograms, of the different lifts of each case."""
    own = effects.where(F.col("lift").isNotNull() & F.col("case_id").isNotNull())
    counts = own.groupBy(F.col("case_id").cast("string").alias("case_id"), F.col("lift").cast("double").alias("lift")).agg(F.count("*").alias("n"))
    lists = counts.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("lift", "n"))).alias("x"))  # one row for each case
    whole = lists.agg(F.sort_array(F.collect_list(F.struct("case_id", "x"))).alias("cases")).where("size(cases) > 0").withColumn("one", F.lit(1))
    tasks = 16
    jobs = effects.sparkSession.range(tasks).withColumn("one", F.lit(1)).join(F.broadcast(whole), "one").select("id", "cases").repartition(tasks, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job, cases in zip(batch.column(0).to_pylist(), batch.column(1)):
                lifts, sizes, shares = [], [], []
                for case in cases.values.field("x"):
                    n = case.values.field("n").to_numpy()
                    lifts.append(case.values.field("lift").to_numpy())
                    sizes.append(int(n.sum()))
                    shares.append(n / n.sum())
                means = []
                for draw in range(job, draws, tasks):
                    rng = np.random.default_rng((seed, draw))
                    picked = rng.integers(len(lifts), size=len(lifts))
                    # all pairs that are drawn are pooled, so a case counts by its pairs
                    means.append(float(sum(rng.multinomial(sizes[c], shares[c]) @ lifts[c] for c in picked) / sum(sizes[c] for c in picked)))
                yield pa.RecordBatch.from_arrays([pa.array(means, pa.float64())], names=["mean"])

    means = jobs.mapInArrow(run, "mean double")
    tail = (1 - level) / 2
    return means.agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high")).where("low is not null")


def keyed_order(rows: DataFrame, id_column: str, key: str, scratch: Scratch) -> DataFrame:
    """(id, position): a permutation that the secret key decides, from 0: the order of the ids' keyed hashes. Ties of the hash fall back on the id."""
    name = F.col(id_column).cast("string")
    placed = rows.select(F.col(id_column).alias("id"), F.concat(hmac_sha256(key.encode(), name), F.lpad(name, 20, "0")).alias("order"), F.lit(1).alias("one"))
    return running_total(placed, "order", "one", scratch).select("id", (F.col("total") - 1).alias("position"))


def order_faults(claimed: DataFrame, id_column: str, key: str, scratch: Scratch) -> DataFrame:
    """(id, claimed, position) of an order (id, position) that isn't the key's."""
    right = keyed_order(claimed, id_column, key, scratch)
    both = claimed.select(F.col(id_column).alias("id"), F.col("position").alias("claimed")).join(right, "id")
    return both.where("claimed <> position or claimed is null")


def allocation(cases: DataFrame, replicates: int, conditions: tuple[str, ...], seed: int) -> DataFrame:
    """(trial_id, pair_id, case_id, replicate, condition, model_seed, dispatch): every case in every replicate under every condition. Ids and the order of
    dispatch are hashes of the seed and what they stand for, so any part of the plan can be made anew by itself."""
    named = lambda size, *parts: F.substring(F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256), 1, size)
    case, replicate, condition = F.col("case_id"), F.col("replicate"), F.col("condition")
    grid = cases.select("case_id").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("condition", F.explode(F.array(*map(F.lit, conditions))))
    pair = F.concat(F.lit("pair-"), named(16, case, replicate))
    trial = F.concat(F.lit("trial-"), named(16, case, replicate, condition))
    return grid.select(trial.alias("trial_id"), pair.alias("pair_id"), "case_id", "replicate", "condition", F.conv(named(8, pair, F.lit("model-seed")), 16, 10).cast("bigint").alias("model_seed"), named(64, trial, F.lit("dispatch")).alias("dispatch"))


def score_coverage(packets: DataFrame, scores: DataFrame, scorers: int) -> DataFrame:
    """(blind_id, fault) of records (blind_id, scorer) against the packets (blind_id) that `scorers` scorers each should have scored once: `unknown` without a packet,
    `repeated` by one scorer, `missing` where fewer scorers did."""
    by = scores.groupBy("blind_id", "scorer").agg(F.count("*").alias("n")).groupBy("blind_id").agg(F.count("*").alias("scorers"), F.max("n").alias("most"))
    both = packets.select("blind_id").distinct().withColumn("packet", F.lit(True)).join(by, "blind_id", "full_outer")
    faults = F.array_compact(F.array(F.when(F.col("packet").isNull(), "unknown"), F.when(F.col("most") > 1, "repeated"), F.when(F.col("packet") & (F.coalesce("scorers", F.lit(0)) < scorers), "missing")))
    return both.select("blind_id", F.explode(faults).alias("fault"))


def score_faults(scores: DataFrame, dimensions: DataFrame, most: int = 4) -> DataFrame:
    """(blind_id, scorer, dimension, fault) of ratings (blind_id, scorer, dimension, rating) against the dimensions (blind_id, dimension) that apply: `rating` for null or beyond 0 to
    `most`, `not_applicable` for a rating of another dimension, `missing` for a dimension that a scorer left out."""
    expected = scores.select("blind_id", "scorer").distinct().join(dimensions.distinct(), "blind_id").withColumn("applies", F.lit(True))
    both = expected.join(scores.withColumn("there", F.lit(True)), ["blind_id", "scorer", "dimension"], "full_outer")
    fault = (
        F.when(F.col("there").isNull(), "missing")
        .when(F.col("applies").isNull(), F.when(F.col("rating").isNotNull(), "not_applicable"))
        .when(F.col("rating").isNull() | (F.col("rating") < 0) | (F.col("rating") > most), "rating")
    )
    return both.select("blind_id", "scorer", "dimension", fault.alias("fault")).where("fault is not null")


def disputes(scores: DataFrame, critical: DataFrame, apart: int = 2) -> DataFrame:
    """(blind_id, dimensions, critical_disputed): where the two first scorers' ratings (blind_id, scorer, dimension, rating) are `apart` or more, and
    whether only one of them saw critical failures (blind_id, scorer, codes). Packets without two scorers have none."""
    gap = scores.groupBy("blind_id", "dimension").agg(F.count("*").alias("n"), (F.max("rating") - F.min("rating")).alias("gap"))
    by = gap.groupBy("blind_id").agg(F.max("n").alias("n"), F.array_join(F.sort_array(F.collect_list(F.when((F.col("gap") >= apart) & (F.col("n") == 2), F.col("dimension").cast("string")))), ";").alias("dimensions"))  # one packet's dimensions
    seen = critical.groupBy("blind_id").agg(F.count("*").alias("raters"), F.count_if(F.size("codes") > 0).alias("saw"))
    both = by.where("n = 2").join(seen, "blind_id", "left").withColumn("critical_disputed", F.coalesce((F.col("raters") == 2) & (F.col("saw") == 1), F.lit(False)))
    return both.where("dimensions <> '' or critical_disputed").select("blind_id", "dimensions", "critical_disputed")


def critical_codes(votes: DataFrame) -> DataFrame:
    """(blind_id, scorers, votes, critical, tie, codes) of (blind_id, scorer, codes): critical by a strict majority of scorers who name any code; codes: all that were
    named, sorted and joined by `;`, where it is critical."""
    by = votes.groupBy("blind_id").agg(F.count("*").alias("scorers"), F.count_if(F.size("codes") > 0).alias("votes"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("codes")))), ";").alias("all"))  # one packet's scorers
    critical = F.col("votes") >= F.floor(F.col("scorers") / 2) + 1
    return by.select("blind_id", "scorers", "votes", critical.alias("critical"), (F.col("votes") * 2 == F.col("scorers")).alias("tie"), F.when(critical, F.col("all")).otherwise("").alias("codes"))


def trial_totals(parts: DataFrame, critical: DataFrame, cap: float, least: float) -> DataFrame:
    """(blind_id, total, passed) of parts (blind_id, hard, quality) and critical (blind_id, critical): their sum, at most `cap` where it is critical; passed from `least` on."""
    both = parts.join(critical.select("blind_id", "critical"), "blind_id", "left").withColumn("critical", F.coalesce("critical", F.lit(False)))
    total = F.col("hard") + F.col("quality")
    total = F.when(F.col("critical"), F.least(total, F.lit(cap).cast("decimal(12,4)"))).otherwise(total)
    return both.select("blind_id", total.alias("total"), "critical").select("blind_id", "total", "critical", ((F.col("total") >= least) & ~F.col("critical")).alias("passed"))


def outcome_summary(trials: DataFrame, *by: str) -> DataFrame:
    """(by, n, mean, median, pass_rate, critical) of trials with total, passed and critical."""
    return trials.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("total").alias("mean"), F.median("total").alias("median"), (F.count_if("passed") / F.count("*")).alias("pass_rate"), F.count_if("critical").alias("critical")
    )


def overall_effect(effects: DataFrame) -> DataFrame:
    """(pairs, wins, ties, win_rate, mean_lift, unpaired) of effects (lift), null where a side is missing."""
    own = F.col("lift").isNotNull()
    return effects.agg(
        F.count_if(own).alias("pairs"), F.count_if(F.col("lift") > 0).alias("wins"), F.count_if(F.col("lift") == 0).alias("ties"),
        (F.count_if(F.col("lift") > 0) / F.nullif(F.count_if(own), F.lit(0))).alias("win_rate"), F.avg("lift").alias("mean_lift"), F.count_if(~own).alias("unpaired"),
    )


def gates(facts: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(stage, gate, passed) of one row of facts: rules gate -> (stage, column). A stage passes (gate `all`) only if the stages before it do, in the order of the rules."""
    stages = list(dict.fromkeys(stage for stage, _ in rules.values()))
    held = lambda c: F.coalesce(c, F.lit(False))
    rows, before = [], F.lit(True)
    for stage in stages:
        own = {gate: held(c) for gate, (s, c) in rules.items() if s == stage}
        for c in own.values():
            before = before & c
        rows += [F.struct(F.lit(stage).alias("stage"), F.lit(gate).alias("gate"), c.alias("passed")) for gate, c in own.items()]
        rows.append(F.struct(F.lit(stage).alias("stage"), F.lit("all").alias("gate"), before.alias("passed")))
    return facts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def citation_integrity(citations: DataFrame, sources: DataFrame, required: DataFrame, most_words: int = 25) -> DataFrame:
    """(trial_id, cited, valid, required, covered, fabricated, disclosed) of citations (trial_id, case_id, place, source_id, visibility, locator, hash, excerpt) against
    the sources (case_id, source_id, visibility, locator, hash, captured_text) and the required ones (case_id, source_id).

    Only the first citation of a source counts, others are fabricated, as are those of no source. A public one is valid if it quotes the text itself, in at most
    `most_words` words, with the source's locator; one that isn't public if it has its locator and hash and no quotation."""
    from pyspark.sql import Window

    own = sources.select("case_id", "source_id", *(F.col(c).alias(f"own_{c}") for c in ("visibility", "locator", "hash", "captured_text")))
    first = F.row_number().over(Window.partitionBy("trial_id", "source_id").orderBy("place")) == 1
    both = citations.withColumn("first", first).join(own, ["case_id", "source_id"], "left").withColumn("known", F.col("own_visibility").isNotNull() & F.col("first"))
    alike = F.col("visibility").eqNullSafe(F.col("own_visibility")) & F.col("locator").eqNullSafe(F.col("own_locator"))
    quoted = F.col("hash").isNull() & F.contains("own_captured_text", "excerpt") & (word_count(F.col("excerpt")) <= most_words)
    closed = F.col("hash").eqNullSafe(F.col("own_hash")) & F.col("excerpt").isNull()
    good = F.col("known") & alike & F.when(F.col("own_visibility") == "public", F.coalesce(quoted, F.lit(False))).otherwise(closed)
    marked = both.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("told", F.col("known") & (F.col("own_visibility") != "public") & F.col("excerpt").isNotNull())
    counts = marked.groupBy("trial_id", "case_id").agg(F.count("*").alias("cited"), F.count_if("good").alias("valid"), F.count_if(~F.col("good")).alias("fabricated"), F.count_if("told").alias("disclosed"))
    need = required.select("case_id", "source_id").distinct()
    covered = citations.select("trial_id", "case_id", "source_id").distinct().join(need, ["case_id", "source_id"]).groupBy("trial_id").agg(F.count("*").alias("covered"))
    return (
        counts.join(need.groupBy("case_id").agg(F.count("*").alias("required")), "case_id", "left").join(covered, "trial_id", "left")
        .select("trial_id", "cited", "valid", F.coalesce("required", F.lit(0)).alias("required"), F.coalesce("covered", F.lit(0)).alias("covered"), "fabricated", "disclosed")
    )


def manifest_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state) of two manifests (path, sha256): `missing`, `extra` or `modified`."""
    both = expected.select("path", F.col("sha256").alias("e")).join(actual.select("path", F.col("sha256").alias("a")), "path", "full_outer")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("a") != F.col("e"), "modified")
    return both.select("path", state.alias("state")).where(F.col("state").isNotNull())
