"""Column expressions. Everything here stays in the JVM; there are no Python UDFs."""
