"""strandloom: code-graph analytics on PySpark.

Typed DataFrames over Parquet hold symbols, call edges, type references and
interface facts; operators answer structural questions on them as lazily
composed plans.
"""

__version__ = "0.1.0"
