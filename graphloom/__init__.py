"""graphloom: property-graph queries, change streams and corpus tools on Spark."""
