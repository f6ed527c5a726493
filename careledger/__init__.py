"""Provenance-first clinical records as Spark DataFrame jobs."""
