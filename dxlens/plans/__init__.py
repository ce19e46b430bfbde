"""Composite jobs (D1-D25) and the pipeline that runs them together."""
