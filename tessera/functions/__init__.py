"""Column-expression helpers (JVM-side, codegen friendly) and schema helpers."""
