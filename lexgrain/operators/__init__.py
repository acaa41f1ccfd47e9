"""DataFrame -> DataFrame transformations; column names are parameters."""
