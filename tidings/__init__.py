"""Company-disclosure analytics as Spark DataFrame transformations."""
