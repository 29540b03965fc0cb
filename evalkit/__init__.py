"""evalkit: long-context tool-use evaluation and corpus preparation on Spark.

Every public function takes and returns Spark ``Column`` or ``DataFrame``
objects built from Spark SQL built-ins, so one plan serves a laptop sample
and a cluster-sized table.
"""

__version__ = "0.1.0"
