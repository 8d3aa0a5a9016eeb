"""Document provenance and fidelity operators as Spark DataFrame jobs."""
