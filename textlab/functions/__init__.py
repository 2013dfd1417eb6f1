"""Column-level functions (pure ``Column -> Column``), all JVM-side built-ins."""
