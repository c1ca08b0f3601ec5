"""Relational operators of the retrieval engine (joins, aggregates, ranking, chunking, graph, vectors)."""
