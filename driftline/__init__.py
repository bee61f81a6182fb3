"""A change-data-capture engine whose change log is a DataFrame."""
