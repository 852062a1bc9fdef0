"""Column expressions: funding rules, periods, ratios of half-lives."""
