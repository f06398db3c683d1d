"""provenir: coding-session provenance analytics on PySpark."""
