"""All registered queries with their SQL oracles."""

from tramline.plans import catalogue, linkage, streams  # noqa: F401 - each registers its queries
from tramline.plans.registered import ORACLES, QUERIES  # noqa: F401
