"""How many detections survive perturbed URLs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlgauge.functions.perturb import ATTACKS, TEXT_MODEL_ATTACK, AttackText, explode_attacks


def success_rates(scored: DataFrame, pred: str = "pred", attacks: Sequence[str] = ATTACKS) -> DataFrame:
    """``attack, n_total, n_missed, adv_success_rate`` for every attack asked about, in their order.

    An attack without rows is reported with a rate of 0.
    """
    counts = scored.groupBy("attack").agg(
        F.count("*").alias("n_total"), F.count_if(F.col(pred) == 0).alias("n_missed")
    )
    names = scored.sparkSession.createDataFrame(list(enumerate(attacks)), "_place int, attack string")
    return names.join(counts, "attack", "left").orderBy("_place").select(
        "attack",
        F.coalesce("n_total", F.lit(0)).alias("n_total"),
        F.coalesce("n_missed", F.lit(0)).alias("n_missed"),
        F.coalesce(F.col("n_missed") / F.col("n_total"), F.lit(0.0)).alias("adv_success_rate"),
    )


def missed_examples(
    scored: DataFrame,
    columns: Sequence[str],
    pred: str = "pred",
    order: Sequence[str] = ("ordinal",),
    rows: int = 5,
    attacks: Sequence[str] = ATTACKS,
) -> DataFrame:
    """The first few missed URLs of each attack, attacks in their own order.

    Spark keeps only the first ``rows`` of each attack per task before the
    shuffle, so a popular attack is no burden.
    """
    missed = scored.filter((F.col(pred) == 0) & F.col("attack").isin(*attacks))
    place = F.row_number().over(Window.partitionBy("attack").orderBy(*order))
    rank = F.array_position(F.array(*[F.lit(a) for a in attacks]), F.col("attack"))
    first = missed.withColumn("example", place).filter(F.col("example") <= rows)
    return first.orderBy(rank, "example").select(*columns, "example")


def attack_detected(
    positives: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    text: AttackText = TEXT_MODEL_ATTACK,
    attacks: Sequence[str] = ATTACKS,
    pred: str = "pred",
) -> DataFrame:
    """Perturb the detected positives and score every variant.

    ``score`` adds a prediction to a table with a ``url`` column.  The result has
    ``url_orig, url_adv, attack`` beside the columns ``score`` adds; a malformed
    URL stays in with NULL as its variant.
    """
    added = [name for name in score(positives).columns if name not in positives.columns]
    detected = score(positives).filter(F.col(pred) == 1).drop(*added)
    variants = explode_attacks(detected, "url", text, attacks)
    return score(variants.withColumnRenamed("url_adv", "url")).withColumnRenamed("url", "url_adv")
