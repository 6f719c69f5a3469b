"""Supply-network risk analytics expressed as Spark DataFrame operators."""
