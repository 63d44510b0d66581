"""stewardlake: a Spark-native data-product catalog and access-governance engine.

Every job is a plain ``DataFrame -> DataFrame`` function with an explicit point
in time (``as_of``). Nothing is collected to the driver inside a job; the
physical plan (broadcast vs. shuffle, partial aggregation, skew handling) is
left to Catalyst and AQE.
"""

__all__ = ["session", "sources", "functions", "operators", "plans", "streaming"]
