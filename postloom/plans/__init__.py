"""Whole jobs, plan helpers and the driver's query registry."""
