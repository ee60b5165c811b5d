"""Writers: partitioned tables, catalog tables, report CSVs."""
