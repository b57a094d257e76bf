"""Column expressions. Everything here is built-in Spark SQL, so it stays inside codegen."""
