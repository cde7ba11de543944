"""The query registry: what ``__spark_entry__`` hands to the driver."""
