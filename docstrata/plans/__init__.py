"""Registered queries over the supplied tables, each with its DuckDB SQL where SQL can say it."""
