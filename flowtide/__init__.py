"""Program-flow analytics on Spark: programs as tables, questions as recursive joins."""
