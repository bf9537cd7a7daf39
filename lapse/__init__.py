"""lapse: customer-retention analytics as Spark DataFrame jobs.

Every operator is a function from DataFrame(s) to DataFrame with the column
names as parameters. Scalars (thresholds, quantiles, extents) are one-row
aggregates attached as scalar subqueries: no join, and no collect on the main
path.
"""

from lapse.session import get_session, checkpoint_dir, materialize

__all__ = ["get_session", "checkpoint_dir", "materialize"]
