"""Ledgerloom: checked, queryable tables from extracted business documents, on PySpark."""
