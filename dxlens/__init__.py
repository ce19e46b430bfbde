"""dxlens: clinical problem-list quality metrics as Spark DataFrame jobs.

Inputs are a versioned terminology (concept names + is-a edges), a log of
problem-list edits, hospital discharges and billing diagnoses.  Every job is a
function from DataFrames to a DataFrame built on Spark's own operators; the
:mod:`dxlens.plans` modules hold the jobs, :mod:`dxlens.operators` the reusable
relational building blocks and :mod:`dxlens.functions` column expressions.
"""

from dxlens.session import ensure_checkpoint_dir, get_session

__all__ = ["get_session", "ensure_checkpoint_dir"]
