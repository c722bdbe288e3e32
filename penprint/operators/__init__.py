"""DataFrame to DataFrame operators and fitted stages."""
