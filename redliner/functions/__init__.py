"""Column functions: everything here is a built-in expression, evaluated in the JVM."""
