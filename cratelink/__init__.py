"""Record linkage, enrichment and roll-up jobs for purchase tables, on Spark."""
