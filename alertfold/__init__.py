"""alertfold: alert compaction and monitoring queries on PySpark DataFrames."""

from alertfold.options import Options

__all__ = ["Options"]
