"""All queries of the library and the SQL of those that have one."""

from __future__ import annotations

from qiyas.plans import catalogue, items, readers, state, studies, vocabulary, written
from qiyas.plans.catalogue import Query

QUERIES: dict[str, Query] = catalogue.QUERIES | studies.QUERIES | state.QUERIES | items.QUERIES | vocabulary.QUERIES | readers.QUERIES | written.QUERIES
ORACLES: dict[str, str] = catalogue.ORACLES | studies.ORACLES | state.ORACLES | items.ORACLES | vocabulary.ORACLES | readers.ORACLES | written.ORACLES
