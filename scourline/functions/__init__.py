"""Column functions: pure Column -> Column, evaluated in the JVM unless said otherwise."""
