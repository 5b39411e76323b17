"""Web pages and JSON payloads to typed, audited tables, as Spark DataFrame operators."""
