"""ridgeloom: route-network analytics and corpus operators on Spark DataFrames."""
