"""Every query, by the ids of the operator inventory."""

from __future__ import annotations

from . import analysis, competency, concepts, evaluation, harvest, insights, keyphrases, passages, scalars, screening, sources, store, streams, validation, writes  # noqa: F401
