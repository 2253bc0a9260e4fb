"""Column-level functions (pure expressions, JVM-side, codegen friendly)."""
