"""Readers of counts and annotation files, and a synthetic source."""
