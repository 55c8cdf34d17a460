"""Payment-dispute reconciliation as Spark DataFrame jobs."""
