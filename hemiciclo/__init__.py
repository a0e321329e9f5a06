"""Policy-text analytics expressed as Spark plans."""
