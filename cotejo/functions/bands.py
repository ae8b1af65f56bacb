"""Bands, flags and small numbers of the reports and of the library's pages."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the bands, of the flags, and of the page and gauge.
HIGH, MODERATE, LOW = 0.8, 0.6, 0.4
RISK_HIGH, RISK_MEDIUM, SIGNIFICANT = 70, 30, 50
PAGE_SIZE, GAUGE_RADIUS = 10, 90
VARIATIONS_LEAST, VARIATIONS_MOST, VARIATIONS_DEFAULT = 1, 10, 3


def semantic_band(similarity: Column) -> Column:
    """Half-open bands; negative values are dissimilar, null stays null."""
    return (
        F.when(similarity >= HIGH, "high")
        .when(similarity >= MODERATE, "moderate")
        .when(similarity >= LOW, "low")
        .when(similarity.isNotNull(), "dissimilar")
    )


def risk_band(percent: Column) -> Column:
    return F.when(percent > RISK_HIGH, "ALTO").when(percent > RISK_MEDIUM, "MEDIO").when(percent.isNotNull(), "BAJO")


def is_significant(percent: Column) -> Column:
    return percent > SIGNIFICANT


def is_equivalent(similarity: Column, threshold: float = HIGH) -> Column:
    return similarity >= threshold


def gauge_offset(percent: Column) -> Column:
    around = 2 * math.pi * GAUGE_RADIUS
    return F.lit(around) - percent / 100 * F.lit(around)


def variations(wanted: Column) -> Column:
    return F.greatest(F.lit(VARIATIONS_LEAST), F.least(F.lit(VARIATIONS_MOST), F.coalesce(wanted, F.lit(VARIATIONS_DEFAULT))))


def page_label(page: Column, total: Column) -> Column:
    """``start–end``, only where there is more than one page."""
    start = (page - 1) * PAGE_SIZE + 1
    label = F.concat(start.cast("string"), F.lit("–"), F.least(page * PAGE_SIZE, total).cast("string"))
    return F.when(total > PAGE_SIZE, label)
