"""Named queries over the driver's tables (one module per operator family)."""

from tessera.plans import q_ingest, q_merge, q_explore, q_prepare, q_stats, q_evaluate, q_tracking, q_model, q_neighbours  # noqa: F401
from tessera.plans.registry import HEADLINE, ORACLES, QUERIES  # noqa: F401
