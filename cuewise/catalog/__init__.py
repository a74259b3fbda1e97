"""Every query by name; importing this package registers them all."""

from cuewise.catalog import analytics, clips, detection, ingest, intervals, jobs, predicates, segmentation, texts  # noqa: F401
from cuewise.catalog.registry import ORACLES, QUERIES  # noqa: F401
