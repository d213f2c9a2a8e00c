"""folio: page reading and analytics on PySpark."""
