"""Operators chained into whole jobs."""
