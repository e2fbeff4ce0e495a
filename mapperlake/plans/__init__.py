"""Whole plans: the engine that ties stages together, reports, and the query catalogue."""
