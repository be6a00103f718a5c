"""Process-flow analytics on Spark: visits, routes, throughput, quality, drift, scoring."""
