"""Queries that the driver runs, with SQL for comparison."""
