"""Column expressions: text, concepts, hashes and vectors. All stay in the JVM."""
