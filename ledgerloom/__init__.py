"""Record and document reconciliation as PySpark DataFrame operators."""
