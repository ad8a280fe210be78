"""Pipelines, manifests and the query catalogue."""
