"""Non-local self-similarity analytics over dense planes, as Spark DataFrame plans."""
