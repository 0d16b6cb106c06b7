"""Tract-level risk analytics expressed as Spark DataFrame operators, ML pipelines and jobs."""
