"""Offer monitoring as Spark jobs: captured pages in, audited offer catalogue out."""
