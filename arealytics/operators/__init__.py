"""DataFrame operators: joins, ranks, scores, spatial statistics and quality checks."""
