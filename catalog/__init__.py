"""Queries over the test tables: Spark plans built from labelworks, and DuckDB SQL to check them."""
