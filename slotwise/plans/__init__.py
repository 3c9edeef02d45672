"""Plan-level building blocks shared by operators: joins, ranking, greedy rounds, lineage."""
