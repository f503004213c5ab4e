"""Log routing and trace analytics as Spark DataFrame operators."""
