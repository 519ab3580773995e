"""Analytics over append-only, hash-chained run logs, written as Spark jobs."""
