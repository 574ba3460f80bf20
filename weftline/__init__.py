"""Column-expression operators for Spark DataFrames: constant catalogs, URL parameters, validated choice."""
