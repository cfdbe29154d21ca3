"""Content-addressed evidence on Spark: facts, event logs, verdicts and audits as DataFrames."""

__version__ = "0.1.0"
