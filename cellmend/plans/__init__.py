"""Rewrites of constraints and the whole repair as a plan of DataFrames."""
