"""Versioned metering time series on Spark: one query over a recent and a historical tier."""
