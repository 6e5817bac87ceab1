"""eventlens: short-post event analytics expressed as Spark DataFrame jobs.

Sub-packages:
  functions  - stateless Column expressions (cleaning, features, time windows)
  sources    - readers and writers (CSV/TSV/Parquet, folder-derived columns)
  operators  - DataFrame -> DataFrame operators (dedupe, grouping, vectors, graph, topics)
  plans      - composed pipelines and the query catalogue used by __spark_entry__
  streaming  - the same stateless functions applied to streaming sources
"""

__version__ = "0.1.0"
