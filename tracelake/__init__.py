"""tracelake: trace and log analytics as plain Spark DataFrame plans."""
