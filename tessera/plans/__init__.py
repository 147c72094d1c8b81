"""Registered analyses over the supplied tables: each entry pairs a Spark
plan with the equivalent DuckDB SQL used as a correctness oracle."""
