"""Operators: plain functions from DataFrames to DataFrames, clock and thresholds as arguments."""
