"""Detectors of a caller's own, beside those of the catalogue or in their place."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lakewarden.functions.catalogue import DETECTORS
from lakewarden.functions.detector import Detector
from lakewarden.operators import sanitize, scan


@dataclass(frozen=True)
class Rules:
    """Detectors in their order, and predicates by the id of their detector.

    A predicate takes a value, its whole text and where it starts (from 0), all
    as columns, and returns whether the value counts: a built-in expression, so
    that a scan stays one narrow stage.
    """

    detectors: tuple[Detector, ...] = DETECTORS
    predicates: Mapping[str, scan.Predicate] = field(default_factory=dict)

    def registered(self, detector: Detector, predicate: scan.Predicate | None = None) -> Rules:
        """These rules and one more, which comes last; one of the same id is replaced where it stands. A detector cannot have a validator and a predicate."""
        if predicate is not None and detector.validator:
            raise ValueError(f"{detector.id} has a validator, so no predicate of its own")
        others = {k: p for k, p in self.predicates.items() if k != detector.id}
        known = any(d.id == detector.id for d in self.detectors)
        detectors = tuple(detector if d.id == detector.id else d for d in self.detectors) + (() if known else (detector,))
        return Rules(detectors, others | ({detector.id: predicate} if predicate is not None else {}))

    def scan(self, docs: DataFrame, **options) -> DataFrame:
        return scan.scan(docs, only=self.detectors, predicates=self.predicates, **options)

    def sanitize(self, docs: DataFrame, **options) -> DataFrame:
        return sanitize.sanitize(docs, detectors=self.detectors, predicates=self.predicates, **options)
