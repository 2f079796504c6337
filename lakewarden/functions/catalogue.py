"""All detectors, in their fixed order, and as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewarden.functions.catalogue_credentials import CREDENTIALS
from lakewarden.functions.catalogue_general import GENERAL
from lakewarden.functions.catalogue_library import LIBRARY
from lakewarden.functions.detector import Detector

DETECTORS: tuple[Detector, ...] = GENERAL + CREDENTIALS + LIBRARY


def table(spark: SparkSession, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """One row per detector, with its place in the order."""
    rows = [(k, d.id, d.label, d.category, d.data_class, d.severity, d.rank, d.level, d.on, d.low, d.secret, d.group, d.validator or None, d.literal or None) for k, d in enumerate(detectors)]
    return spark.createDataFrame(rows, "ordinal int, rule_id string, label string, category string, classification string, severity string, rank int, tier string, default_on boolean, low_confidence boolean, secret boolean, value_group int, validator string, literal string")
