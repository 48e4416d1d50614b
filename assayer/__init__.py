"""assayer: corpus preparation and detector evaluation as Spark jobs."""
