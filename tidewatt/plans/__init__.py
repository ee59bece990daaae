"""What is decided before Spark plans: ranges, tiers, resolution and what a statement may do."""
