"""Column expressions and scale helpers; everything here stays inside the JVM."""
