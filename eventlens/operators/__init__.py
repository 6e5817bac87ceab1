"""Operators on whole tables: rows, schemas, vectors, clusters, graphs, topics."""
