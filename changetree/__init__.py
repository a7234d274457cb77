"""changetree: Spark operators over versioned, hierarchical, multi-tenant change data."""
