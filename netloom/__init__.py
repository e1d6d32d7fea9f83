"""Correlation-network analytics on Spark DataFrames.

Data model: activity (net, sample, region, value), edges (net, src, dst, ...) with src < dst, vertices (net, node),
membership (net, node, comm), partitions (net, part, node, comm). `net` names one network; every operator works on all
networks of a table in one job.
"""
