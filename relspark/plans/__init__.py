"""Plans: the session's settings and the catalogue of queries."""
