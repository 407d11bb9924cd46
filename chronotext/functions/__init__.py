"""Column expressions; all of them stay in the JVM unless their docstring says otherwise."""
