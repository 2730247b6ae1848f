"""Table statistics, classic Spark programs, run-log analytics and schedule windows as DataFrame jobs."""
