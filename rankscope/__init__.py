"""rankscope: retrieval-reranking benchmark analytics as Spark DataFrame plans.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing is collected to the driver except bounded summaries
(per-partition counts, configuration checks).
"""

__version__ = "0.1.0"
