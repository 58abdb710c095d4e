"""ledgerloom: a PySpark-native engine for financial documents and market series."""
