"""The complete jobs: profile a corpus, train and predict, ensemble, stack, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrain.operators import compare, ensemble, models, profile
from lexgrain.session import kept_table


def profile_corpus(train: DataFrame, test: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every part of the corpus report as its own DataFrame; nothing runs until one is used.

    ``train`` holds ``id, sentence, label``, ``test`` at least ``sentence``.  Persist ``train``
    first if several parts are wanted and reading it is expensive.
    """
    report = {
        "label_distribution": profile.label_distribution(train),
        "lengths": profile.length_profile(train),
        "stats_by_label": profile.stats_by_label(train),
        "vocabulary": profile.vocab_totals(train),
        "vocabulary_by_label": profile.vocab_by_label(train),
        "vocabulary_overlap": profile.vocab_overlap(train),
        "top_words": profile.top_words(train),
        "feature_means": profile.feature_means_long(train),
        "word_histogram": profile.word_histogram(train),
        "box_stats": profile.box_stats(train),
        "box_outliers": profile.box_outliers(train),
    }
    if test is not None:
        report["test_lengths"] = profile.length_profile(test, metrics=("words",))
    return report


def train_and_predict(
    train: DataFrame, test: DataFrame, **options
) -> tuple[models.TextClassifier, DataFrame]:
    """Fit the text classifier and score ``test``; options as in ``fit_text_classifier``."""
    classifier = models.fit_text_classifier(train, **options)
    return classifier, classifier.predict(test)


def cross_validated_scores(
    folded: DataFrame, test: DataFrame, k: int = 5, name: str = "a", **options
) -> tuple[DataFrame, DataFrame]:
    """Fit one model per fold: out-of-fold predictions of ``folded`` and fold logits of ``test``.

    Both carry features.  The logits go to ``ensemble_predict`` or, with the out-of-fold sets of two
    models, to ``stack_and_predict``.
    """
    folded = kept_table(folded, "folded")
    fitted = models.fit_folds(folded, k, **options)
    return models.out_of_fold(folded, k, models=fitted), models.score_folds(fitted, test, name)


def ensemble_predict(fold_logits: DataFrame) -> DataFrame:
    """``(id, label)`` of one model: mean logits over its folds, then softmax and argmax."""
    return ensemble.mean_logit(fold_logits).select("id", "label")


def stack_and_predict(
    oof_a: DataFrame, oof_b: DataFrame, logits_a: DataFrame, logits_b: DataFrame
) -> tuple[models.Stacker, DataFrame]:
    """Fit the stacker on two aligned out-of-fold sets and score two sets of fold logits.

    Test scores are the mean probability over the folds of each model.  Sets whose ids or labels
    differ are rejected; their order does not matter.
    """
    ensemble.require_aligned(oof_a, oof_b)
    stacker = models.Stacker.fit(ensemble.stack_probabilities(oof_a, oof_b))
    stacked = ensemble.stack_probabilities(
        ensemble.mean_probability(logits_a), ensemble.mean_probability(logits_b)
    )
    return stacker, stacker.predict(stacked).select("id", F.col("target").alias("label"))


def compare_models(
    predictions: DataFrame, runs: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Distribution and pairwise agreement of predictions, and the summary and winner of runs.

    With ``runs`` only predictions of successful runs are compared.
    """
    if runs is not None:
        keys = ["model", *({"experiment"} & set(predictions.columns) & set(runs.columns))]
        succeeded = runs.where("success").withColumnRenamed("name", "model").select(*keys).distinct()
        predictions = predictions.join(succeeded, keys, "left_semi")
    report = {
        "distribution": compare.prediction_distribution(predictions),
        "agreement": compare.pairwise_agreement(predictions),
    }
    if runs is not None:
        report["summary"] = compare.run_summary(runs)
        report["best"] = compare.rank_runs(runs)
    return report
