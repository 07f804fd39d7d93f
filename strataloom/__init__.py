"""A Spark-native engine over content-addressed registries, their telemetry, ledgers and vectors."""
