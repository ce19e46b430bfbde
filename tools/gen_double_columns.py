"""Print the double-valued result columns of every registered query.

The output is pasted into ``dxlens/oracle.py`` (``DOUBLE_COLUMNS``): the oracle
rounds exactly those columns, as the Spark side rounds every double column.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T  # noqa: E402

from dxlens import get_session  # noqa: E402
from dxlens.plans.catalog import _JOBS, metrics  # noqa: E402

spark = get_session("local[4]", shuffle_partitions=4)
m = metrics(spark, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", materialise="none")
print("DOUBLE_COLUMNS = {")
for name, (_, job) in _JOBS.items():
    if name in ("discharge_summary_int", "activity_ratios_int"):
        continue
    cols = [f.name for f in job(m).schema.fields if isinstance(f.dataType, T.DoubleType)]
    print(f"    {name!r}: {cols!r},")
print("}")
