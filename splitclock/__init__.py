"""splitclock: timed-stage analytics written as plain Spark jobs."""
