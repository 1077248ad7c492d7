"""Column expressions. Nothing here starts a job or leaves the JVM."""
