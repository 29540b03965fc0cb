"""Plan-shaping helpers that keep global orders, prefix sums and medians
distributed: no single-partition window over a whole table, no group
gathered into one task, broadcasts only behind a size check."""
