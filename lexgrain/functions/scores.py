"""Expressions on logits and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(value: Column, like: Column) -> Column:
    """``value`` once per element of ``like``.

    Used inside a lambda instead, it would be evaluated again for every element.
    """
    return F.array_repeat(value, F.size(like))


def _shifted(logits: Column) -> Column:
    return F.zip_with(logits, _each(F.array_max(logits), logits), lambda x, top: x - top)


def softmax(logits: Column) -> Column:
    """Softmax of an ``array<double>``, shifted by the maximum; linear in the number of classes."""
    exps = F.transform(_shifted(logits), F.exp)
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.zip_with(exps, _each(total, logits), lambda x, s: x / s)


def positive_probability(logit_0: Column, logit_1: Column) -> Column:
    """Softmax probability of class 1 for two logits; stays in generated code."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(logit_0 - logit_1))


def log_softmax(logits: Column) -> Column:
    shifted = _shifted(logits)
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + F.exp(x))
    return F.zip_with(shifted, _each(F.ln(total), logits), lambda x, s: x - s)


def argmax(values: Column) -> Column:
    """Zero-based position of the largest value; the first one wins a tie, NaN counts as largest."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def binary_argmax(logit_0: Column, logit_1: Column) -> Column:
    return F.when(logit_1 > logit_0, 1).otherwise(0)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``; 0.0 for a zero denominator, null if either side is null."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent; null for an empty whole."""
    return F.try_divide(part * F.lit(100.0), whole)
