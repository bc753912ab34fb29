"""Monitors: each module turns tables or history into result DataFrames."""
