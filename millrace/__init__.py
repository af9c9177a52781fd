"""Millrace: analytics over prioritised message workloads, written as PySpark DataFrame jobs."""
