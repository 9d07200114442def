"""Column expressions shared by the operators; all of them stay inside the JVM."""
