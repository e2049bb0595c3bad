"""Relations, comparison of results, suites and reports."""
