"""Corpusloom: evidence-traceable retrieval and corpus engineering as plain Spark jobs."""
