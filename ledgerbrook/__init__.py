"""Append-only event analytics on PySpark: typed logs, predicates, time-bucket aggregates, triggers, sketches."""
