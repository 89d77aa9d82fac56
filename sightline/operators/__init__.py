"""Operators on DataFrames: adapters, merges, pages, graph, similarity and gates."""
