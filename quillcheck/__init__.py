"""Record checking, reconciliation and rule mining as Spark DataFrame jobs."""
