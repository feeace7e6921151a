"""Column expressions shared by the operators; all of them run in the JVM."""
