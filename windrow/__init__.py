"""windrow: declarative windowed analytics over event streams, as plain Spark DataFrame and SQL plans."""
