"""Registered queries, by area: each module has QUERIES (name -> function) and SQL (name -> DuckDB SQL)."""
