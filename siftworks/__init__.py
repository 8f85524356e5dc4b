"""siftworks: search analytics and corpus processing as Spark DataFrame operators."""
