"""Column functions: pure expressions, evaluated in the JVM."""
