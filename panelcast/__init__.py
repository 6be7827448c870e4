"""Daily route panels, features, baselines and error reports as Spark DataFrame operators."""
