"""Column expressions. All are built-in functions; none leaves the JVM."""
