"""Looking into one model: its errors, and how it stands up to perturbed URLs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from urlgauge.functions.perturb import TEXT_MODEL_ATTACK, AttackText
from urlgauge.operators.errors import error_profile, top_false_negatives, top_false_positives, with_error_type
from urlgauge.operators.explore import value_counts
from urlgauge.operators.robustness import attack_detected, missed_examples, success_rates
from urlgauge.operators.split import SEED, exact_sample
from urlgauge.session import materialize
from urlgauge.sources.writers import read_error_slice, write_error_slices

Score = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class ErrorReport:
    """Tables of an error analysis; ``scored`` is stored, the rest are lazy."""

    scored: DataFrame
    counts: DataFrame
    profile: DataFrame
    false_positives: DataFrame
    false_negatives: DataFrame


def analyse_errors(test: DataFrame, score: Score, folder: str) -> ErrorReport:
    """Score ``test``, store it by error class under ``folder``, and describe it.

    ``score`` adds ``pred`` and ``proba``.  It runs once; the reports read the
    stored classes, and those about one class read no other.
    """
    write_error_slices(with_error_type(score(test)), folder)
    scored = read_error_slice(test.sparkSession, folder)
    return ErrorReport(
        scored,
        value_counts(scored, "error_type"),
        error_profile(scored),
        top_false_positives(scored),
        top_false_negatives(scored),
    )


@dataclass(frozen=True)
class RobustnessReport:
    """Perturbed and re-scored URLs, with success rates and examples."""

    attacked: DataFrame
    rates: DataFrame
    examples: DataFrame


def analyse_robustness(
    test: DataFrame,
    score: Score,
    rows: int | None = None,
    text: AttackText = TEXT_MODEL_ATTACK,
    seed: int = SEED,
) -> RobustnessReport:
    """Perturb the detected positives, or ``rows`` of the positives; ``score`` adds ``pred`` and ``proba``."""
    positives = test.filter("label = 1").select("url", "label")
    positives = positives if rows is None else exact_sample(positives, rows, seed=seed)
    attacked = materialize(attack_detected(positives, score, text))
    columns = ["attack", "url_orig", "url_adv", "proba"]
    return RobustnessReport(
        attacked, success_rates(attacked), missed_examples(attacked, columns, order=["url_orig"])
    )
