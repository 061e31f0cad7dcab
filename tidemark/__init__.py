"""Auditable market and event data jobs, written as Spark DataFrame functions."""
