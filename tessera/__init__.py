"""Tessera: analytics over versioned, time-stamped text on Spark."""
