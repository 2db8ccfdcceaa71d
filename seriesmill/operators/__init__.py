"""DataFrame-in, DataFrame-out operators on series tables."""
