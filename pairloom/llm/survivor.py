"""Problem 4: the best representative of each cluster delivered several times.

Feeds claim values for the fields of a cluster. A latent two-sided quality model infers, for each feed and field, its
sensitivity (how often it states a true value) and specificity (how often it withholds a false one) by
expectation-maximisation; a claim's posterior follows from who stated it and who had a say but did not. Several
values of a field may be judged true, and all are kept. The surviving record of each field is then chosen by the
order that the field's rule prescribes among the claims.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pairloom.staging import stage

Key = tuple[str, str]
FIELDS = ("forward_barcode", "reverse_barcode", "quality_first")
BARCODE_CHARS = {"forward_barcode": 14, "reverse_barcode": 12}
#: Rounds end when no rate moves by more than STILL, and at the latest after ROUNDS.
ROUNDS, STILL = 500, 1e-9
#: Patterns of stating and denying feeds up to which the rounds run on the patterns' counts in one place; more are kept in
#: a table, and each round is a job.
PATTERNS = 100_000
#: Prior share of true claims; the rate that is held against a feed's own record, and the weight it has, as a share of
#: the feed's claims (without any, feeds that err together can end up trusted).
PRIOR, RATE, WEIGHT = 0.6, 0.8, 0.1


def _blankless(c: str) -> Column:
    return F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))


def _barcode_score(field: str) -> Column:
    """0 for a barcode that can't survive, else 1 more than the letters that are no N."""
    n, v = BARCODE_CHARS[field], _blankless(field)
    good = F.length(F.regexp_replace(v, "N", ""))
    return F.when(v.rlike(rf"^[ACGTN]{{{n}}}\z") & (good > 0), good + 1).otherwise(0)


def _quality_score() -> Column:
    """0 for a quality that can't survive, else 1 more than its length."""
    n = F.length(F.regexp_replace("readseq_first", "[^A-Za-z]+", ""))
    q = F.col("quality_first")
    return F.when(q.rlike(r"^[!-J]*\z") & (F.length(q) == n), F.length(q) + 1).otherwise(0)


def deliveries(reads: DataFrame) -> DataFrame:
    """Rows of the clusters with two or more records: job and cluster name, the fields and their scores. A cluster is
    a ``job_id`` with the ``read_name_first`` up to its first space; rows with a null in either belong to none."""
    rows = reads.select(
        "ordinal", "job_id", F.substring_index("read_name_first", " ", 1).alias("cluster"), "feed", "received_at",
        *[_blankless(f).alias(f) for f in FIELDS[:2]], "quality_first",
        *[_barcode_score(f).alias(f"score_{f}") for f in FIELDS[:2]], _quality_score().alias("score_quality_first"),
    ).where("job_id is not null and cluster is not null")
    many = rows.groupBy("job_id", "cluster").agg(F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(many, ["job_id", "cluster"])


def claims(rows: DataFrame) -> DataFrame:
    """One row for each cluster, field and value stated: the feeds that stated it (``said``) and those that stated
    only other values of the field (``denied``). Lists are bounded by the number of feeds."""
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])
    stated = rows.select("first_ordinal", F.coalesce("feed", F.lit("")).alias("feed"), F.explode(values).alias("c")).select("first_ordinal", "feed", "c.*").where("value is not null")
    said = stated.groupBy("first_ordinal", "field", "value").agg(F.sort_array(F.collect_set("feed")).alias("said"))
    asked = stated.groupBy("first_ordinal", "field").agg(F.sort_array(F.collect_set("feed")).alias("asked"))
    return said.join(asked, ["first_ordinal", "field"]).withColumn("denied", F.array_except("asked", "said")).drop("asked")


def fit(found: DataFrame, rounds: int = ROUNDS) -> dict[tuple[str, str], tuple[float, float]]:
    """(field, feed) -> (sensitivity, specificity), by expectation-maximisation over all claims until the rates stand
    still. Claims with the same
    field, stating and denying feeds are counted together first; the driver sees one row for each field and feed."""
    patterns = stage(found.groupBy("field", "said", "denied").agg(F.count(F.lit(1)).alias("n")), "claim_patterns")
    some = patterns.limit(PATTERNS + 1).collect()
    few = len(some) <= PATTERNS
    feeds = patterns.select("field", F.explode(F.concat("said", "denied")).alias("feed")).distinct().collect()
    rates = {(r["field"], r["feed"]): (RATE, RATE) for r in feeds}
    step = _few_rounds(some, sorted(rates)) if few else lambda now: _round(patterns, now)
    for _ in range(rounds if rates else 0):
        before, rates = rates, step(rates)
        if all(abs(x - y) < STILL for k in rates for x, y in zip(rates[k], before[k], strict=True)):
            break
    return rates


def _new_rates(sums: dict[Key, tuple[float, float, float, float]]) -> dict[Key, tuple[float, float]]:
    """Rates from the sums of true claims, true and stated ones, false claims, false and denied ones."""
    own = {k: WEIGHT * (true + false) for k, (true, _, false, _) in sums.items()}
    return {k: ((true_said + RATE * own[k]) / (true + own[k]), (false_denied + RATE * own[k]) / (false + own[k])) for k, (true, true_said, false, false_denied) in sums.items()}


def _round(patterns: DataFrame, rates: dict[Key, tuple[float, float]]) -> dict[Key, tuple[float, float]]:
    scored = patterns.withColumn("p", posterior(rates))
    votes = F.concat(
        F.transform("said", lambda x: F.struct(x.alias("feed"), F.lit(1.0).alias("yes"))),
        F.transform("denied", lambda x: F.struct(x.alias("feed"), F.lit(0.0).alias("yes"))),
    )
    each = scored.select("field", "n", "p", F.explode(votes).alias("v")).groupBy("field", "v.feed").agg(
        F.sum(F.col("n") * F.col("p")).alias("true"),
        F.sum(F.col("n") * F.col("p") * F.col("v.yes")).alias("true_said"),
        F.sum(F.col("n") * (1 - F.col("p"))).alias("false"),
        F.sum(F.col("n") * (1 - F.col("p")) * (1 - F.col("v.yes"))).alias("false_denied"),
    ).collect()
    return _new_rates({(r["field"], r["feed"]): (r["true"], r["true_said"], r["false"], r["false_denied"]) for r in each})


def _few_rounds(patterns: list[Row], keys: list[Key]) -> Callable[[dict[Key, tuple[float, float]]], dict[Key, tuple[float, float]]]:
    """As :func:`_round`, over the counts of at most PATTERNS patterns."""
    place = {k: i for i, k in enumerate(keys)}
    votes = [(i, place[r["field"], feed], yes) for i, r in enumerate(patterns) for feeds, yes in ((r["said"], 1.0), (r["denied"], 0.0)) for feed in feeds]
    of, who, yes = (np.array(x) for x in zip(*votes, strict=True)) if votes else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    n = np.array([r["n"] for r in patterns], float)

    def step(rates: dict[Key, tuple[float, float]]) -> dict[Key, tuple[float, float]]:
        sens, spec = np.array([rates[k] for k in keys]).T
        said, denied = np.log(sens / (1 - spec)), np.log((1 - sens) / spec)
        odds = math.log(PRIOR / (1 - PRIOR)) + np.bincount(of, np.where(yes > 0, said[who], denied[who]), len(n))
        p = 1 / (1 + np.exp(-odds))
        weights = ((n * p)[of], (n * p)[of] * yes, (n * (1 - p))[of], (n * (1 - p))[of] * (1 - yes))
        return _new_rates(dict(zip(keys, zip(*[np.bincount(who, w, len(keys)).tolist() for w in weights], strict=True), strict=True)))

    return step


def posterior(rates: dict[tuple[str, str], tuple[float, float]]) -> Column:
    """Probability that a claim is true, from the feeds' rates (a literal map, bounded by fields x feeds)."""
    if not rates:
        return F.lit(PRIOR)
    yes = F.create_map(*[F.lit(x) for (f, s), (sens, spec) in sorted(rates.items()) for x in (f"{f}/{s}", math.log(sens / (1 - spec)))])
    no = F.create_map(*[F.lit(x) for (f, s), (sens, spec) in sorted(rates.items()) for x in (f"{f}/{s}", math.log((1 - sens) / spec))])
    def add(table: Column, feeds: str) -> Column:
        return F.aggregate(feeds, F.lit(0.0), lambda acc, s: acc + F.coalesce(table[F.concat_ws("/", F.col("field"), s)], F.lit(0.0)))

    odds = F.lit(math.log(PRIOR / (1 - PRIOR))) + add(yes, "said") + add(no, "denied")
    return 1 / (1 + F.exp(-odds))


def resolve(reads: DataFrame, feeds: DataFrame, by: str = "rules") -> DataFrame:
    """One row for each cluster of two or more records: ``first_ordinal``; of each field the ordinal of the record whose
    value survives (-1: none can) and the posterior of that value.

    Rules: a barcode can survive if, without blanks at its ends and in upper case, it has the field's number of letters
    of ACGTN, not all N, and fewer N win; a quality if it holds only ``!`` to ``J`` and is as long as its read has
    ASCII letters, and the longer wins. Ties: more trusted feed (unknown feeds last), later ``received_at`` (null
    last), larger ordinal. ``by="rules"``: these rules settle every choice, and the posterior only tells how far the
    feeds' record supports it. ``by="posterior"``: of the values that can survive the likeliest does, and the rules decide
    among records that state it or values as likely. Extra columns are not read; empty tables give no rows.
    """
    if by not in ("rules", "posterior"):
        raise ValueError(f"by={by!r}: rules or posterior")
    rows = stage(deliveries(reads), "deliveries")
    judged = claims(rows)
    judged = judged.withColumn("posterior", posterior(fit(judged)))
    trust = feeds.groupBy("feed").agg(F.max("trust").alias("trust"))
    scores = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col(f"score_{f}").alias("score")) for f in FIELDS])
    stated = rows.join(trust, "feed", "left").select("first_ordinal", "ordinal", "trust", "received_at", F.explode(scores).alias("c"))
    stated = stated.select("first_ordinal", "ordinal", "trust", "received_at", "c.*").join(judged.select("first_ordinal", "field", "value", "posterior"), ["first_ordinal", "field", "value"], "left")
    rules = ["score", "trust", "received_at", "ordinal"]
    order = F.struct(*([*rules, "posterior"] if by == "rules" else [F.round("posterior", 6).alias("likely"), *rules, "posterior"]))
    best = [F.max(F.when((F.col("field") == f) & (F.col("score") > 0), order)).alias(f) for f in FIELDS]
    out = stated.groupBy("first_ordinal").agg(*best)
    names = dict(zip(FIELDS, ("fbc", "rbc", "qual"), strict=True))
    ordinals = [F.coalesce(F.col(f"{f}.ordinal"), F.lit(-1).cast("long")).alias(f"{n}_ordinal") for f, n in names.items()]
    return out.select("first_ordinal", *ordinals, *[F.col(f"{f}.posterior").alias(f"{n}_posterior") for f, n in names.items()])


def truths(reads: DataFrame, least: float = 0.5) -> DataFrame:
    """Every value judged true, by cluster and field: ``first_ordinal``, ``field``, ``value``, ``posterior``."""
    judged = claims(stage(deliveries(reads), "deliveries"))
    return judged.withColumn("posterior", posterior(fit(judged))).where(F.col("posterior") >= least).select("first_ordinal", "field", "value", "posterior")


def sources(reads: DataFrame) -> DataFrame:
    """Sensitivity and specificity of each feed and field."""
    rates = fit(claims(stage(deliveries(reads), "deliveries")))
    rows = [(f, s, *map(float, r)) for (f, s), r in sorted(rates.items())]
    return reads.sparkSession.createDataFrame(rows, "field string, feed string, sensitivity double, specificity double")
