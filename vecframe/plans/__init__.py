"""Filters, queries and their languages, and the planner that turns them into DataFrames."""
