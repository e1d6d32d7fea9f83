"""The library's queries over the test tables, and their DuckDB SQL."""
