"""Ocean-profile analytics expressed as Spark DataFrame jobs."""
