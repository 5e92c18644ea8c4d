"""Query-workload analytics on Spark DataFrames.

Sub-packages: ``sources`` (reading corpora and plan logs, writing reports),
``operators`` (text, statements, predicates, metadata, paths, parameters),
``plans`` (execution plans, scores, index advice), ``streaming`` (incremental
scans), ``functions`` (column expressions and scale helpers).
"""

__version__ = "0.1.0"
