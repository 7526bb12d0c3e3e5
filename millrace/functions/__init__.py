"""Column functions: built-in expressions only, so that they stay in the JVM."""
