"""Image-corpus and text-corpus analytics as Spark DataFrame operators."""
