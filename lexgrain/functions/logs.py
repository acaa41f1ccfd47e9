"""Expressions that read metrics out of captured run output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexgrain.functions import charclasses as cc

# Fixed value: how a run reports its validation accuracy.
ACCURACY_PATTERN = rf"Validation Accuracy:{cc.WS}*([0-9]+\.[0-9]+)"


def extract_accuracy(text: Column) -> Column:
    """First reported validation accuracy in ``text`` as a double; null if there is none."""
    return F.nullif(F.regexp_extract(text, ACCURACY_PATTERN, 1), F.lit("")).try_cast("double")
