"""Named plans over the driver tables: what ``__spark_entry__`` registers."""
