"""Column expressions: pure, JVM-side, codegen friendly."""
