"""Ponderloom: reasoning-trace analytics on Spark DataFrames."""
