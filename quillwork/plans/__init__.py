"""All registered queries. Importing a module of this package registers its queries."""

from quillwork.plans import (  # noqa: F401
    corpus,
    events,
    family,
    health,
    metrics,
    outline,
    pipeline,
    raster,
    segment,
)
from quillwork.plans.registry import ORACLES, QUERIES  # noqa: F401
