"""Table operators over versioned readings."""
