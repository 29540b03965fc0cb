"""Column-level functions (Spark SQL built-ins only; whole-stage codegen friendly)."""
