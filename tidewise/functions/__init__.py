"""Column expressions: calendar parts, moon phase, frequency ladder, offsets.

All are built-in Spark expressions, so they run inside whole-stage codegen;
none is a Python UDF."""
