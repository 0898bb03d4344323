"""DataFrame operators for multi-level order-book snapshot tables on Spark."""
