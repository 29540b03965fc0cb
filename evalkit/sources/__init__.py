"""Sources and sinks: the test tables, result files, prompt dumps, catalogs."""
