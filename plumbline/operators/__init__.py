"""Operators over DataFrames: counting, gates, hierarchies, baselines, checks, companions and layout."""
