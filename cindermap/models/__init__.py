"""Spark ML pipelines, scoring and evaluation."""
