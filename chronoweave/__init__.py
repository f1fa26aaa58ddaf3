"""chronoweave: Spark-native preparation and query engine for sensor telemetry.

Every operator is a ``DataFrame -> DataFrame`` function built from the
DataFrame API, so Catalyst plans the whole chain (cleaning, gap handling,
bad-data intervals, downsampling, catalogue lookups) as one lazy job.
"""

from chronoweave.session import build_session, checkpoint_dir, cut_lineage

__all__ = ["build_session", "checkpoint_dir", "cut_lineage"]
