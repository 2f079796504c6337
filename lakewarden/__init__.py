"""lakewarden: text protection and activity analytics as Spark DataFrame jobs."""
