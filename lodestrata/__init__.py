"""A Spark engine for static inspection of source repositories, and for preparing training data."""
