"""Where readings come from: the two tiers, and the test tables."""
