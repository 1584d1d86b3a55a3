"""Operators on DataFrames: index build, ranking, evaluation, link graphs, crawl, assessment."""
