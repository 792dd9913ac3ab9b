"""Mail and document evidence analytics as Spark DataFrame plans."""
