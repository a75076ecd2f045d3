"""Native Column expressions; none of them is a UDF."""
