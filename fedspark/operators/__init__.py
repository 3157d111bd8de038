"""Operators on DataFrames of samples, parameters, scores and histories."""
