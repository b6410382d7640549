"""Writers: partitioned tables, delimited series, JSON observations, catalog tables."""
