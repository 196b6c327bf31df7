"""Table declarations, readers, sinks and the mapping from the star-schema files."""
