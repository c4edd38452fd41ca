"""Column expressions: all JVM-side, none needs a Python worker."""
