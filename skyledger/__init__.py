"""Spark-first analytics over cloud audit events and permission snapshots."""
