"""Plan shapes shared by the operators: fused rules, rank selection, prefix totals, lookups."""
