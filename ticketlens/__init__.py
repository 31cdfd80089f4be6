"""Table-level operators for network-operations ticket analytics on Spark."""
