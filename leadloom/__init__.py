"""Company prospecting analytics as ordinary Spark DataFrame transforms."""
