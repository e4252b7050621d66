"""Optional detectors by settings: which are made, which must be there, and what became of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanveil.config import Settings
from spanveil.operators.names import Detectors
from spanveil.shipping import ship


class ModelError(RuntimeError):
    """A model that the settings require can't be made."""


@dataclass(frozen=True)
class ModelPlan:
    """Makes ``Detectors`` in a worker; picklable if its factories are.

    ``contacts()`` gives a function of a text to (entity type, start, end),
    ``names(model, labels)`` one to dicts with label, score, and start and end or
    text. A detector that the settings turn off isn't made. One that fails is
    left out and its failure recorded, or raises if the settings require it.
    Predictions below the threshold, or of other labels, don't count.
    """

    settings: Settings = Settings()
    contacts: Callable[[], Callable] | None = None
    names: Callable[[str, tuple[str, ...]], Callable] | None = None

    def __call__(self) -> Detectors:
        s, made, failures = self.settings, {}, []
        plans = (
            ("contacts", s.use_contact_model, s.require_contact_model, self.contacts and (lambda: self.contacts())),
            ("names", s.use_name_model, s.require_name_model, self.names and (lambda: self._names())),
        )
        for name, used, required, make in plans:
            if not used:
                continue
            try:
                if make is None:
                    raise ModelError(f"no {name} model is given")
                made[name] = make()
            except Exception as e:
                if required:
                    raise ModelError(f"the {name} model is required: {e}") from e
                failures.append(f"{name}: {e}")
        return Detectors(failures=tuple(failures), **made)

    def _names(self) -> Callable[[str], list[dict]]:
        s = self.settings
        predict, labels = self.names(s.name_model, s.name_model_labels), {x.lower() for x in s.name_model_labels}
        return lambda text: [p for p in predict(text) if p.get("score", 1.0) >= s.name_model_threshold and str(p.get("label") or "").lower() in labels]


def failures(spark: SparkSession, plan: ModelPlan) -> DataFrame:
    """(failure): what could not be made, as a worker found."""
    ship(spark)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array(plan().failures, pa.string())], ["failure"])

    return spark.range(1, numPartitions=1).mapInArrow(probe, "failure string")
