"""Analytics for language-learning material, expressed as Spark DataFrame transformations."""
