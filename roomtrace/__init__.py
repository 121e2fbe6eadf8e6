"""Rental-listing, booking and agent-trace analytics on Spark DataFrames."""
