"""DataFrame-in, DataFrame-out operators: spatial joins, graph searches, route measures, ranking."""
