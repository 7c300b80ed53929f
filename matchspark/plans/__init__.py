"""Plan shapes shared by the operators: prefix totals, bounded look-back, order statistics."""
