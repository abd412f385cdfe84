"""Column-level building blocks, all JVM-side expressions."""
