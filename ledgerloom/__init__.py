"""Ledgerloom: aggregate questions over overlapping, conflicting sources, on Spark."""
