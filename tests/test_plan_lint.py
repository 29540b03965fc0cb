"""Scale guards over every registered query's physical plan: no cartesian
products, and no window without a partition key except the one over the
per-partition counts inside ``global_index`` (at most one row per partition) and the one
over the top n keys of the fixed quota."""

import re

from evalkit.queries import QUERIES, load_all
from tests.conftest import SF_SMALL

NO_PARTITION_WINDOW = re.compile(r"Window \[.*\], \[\], \[")


def test_plans_have_no_cartesian_products_or_global_windows(spark):
    bad = []
    load_all()
    for key, fn in QUERIES.items():
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan:
            bad.append((key, "cartesian"))
        for line in plan.split("\n"):
            if NO_PARTITION_WINDOW.search(line) and "_ek_pid" not in line and key != "calib_fixed_quota":
                bad.append((key, line.strip()[:120]))
    assert bad == []
