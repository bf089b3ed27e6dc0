"""Whole analyses: views over input tables, the end-to-end run, the query catalogue."""
