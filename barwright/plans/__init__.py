"""All registered queries: importing this package fills the registry."""

from barwright.plans import bars_queries, holdout_queries, joins_queries, lake_queries, quality_queries, research_queries, roll_queries, stream_queries, study_queries, validated_queries  # noqa: F401
from barwright.plans.registry import ORACLES, QUERIES  # noqa: F401
