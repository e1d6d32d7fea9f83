"""Operators on activity, edges, membership and results."""
