"""Jobs for a large photo catalogue and its search, on Spark."""
