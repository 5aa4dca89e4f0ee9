"""Building blocks of plans: staging, global order, Gram aggregates, query registration."""
