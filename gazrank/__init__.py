"""Article relevance triage on Spark.

Sub-packages:

* ``sources``    – table loading, the article adapter, CSV / Parquet IO,
  model bundles.
* ``functions``  – pure ``Column -> Column`` text and hash expressions.
* ``operators``  – DataFrame operators: cuts, joins, aggregates, splits,
  vectorisation, similarity, ranking metrics.
* ``ml``         – MLlib stages, models, tuning and clustering.
* ``plans``      – the registered queries and their SQL oracles.
* ``streaming``  – Structured Streaming scoring and decay monitoring.
"""

__version__ = "0.1.0"
