"""Message screening and safety analytics as Spark DataFrame operators."""
