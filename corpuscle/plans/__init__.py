"""Jobs that put operators together, and the queries that show each operator on the driver's tables."""
