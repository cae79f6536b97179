"""streaming of quern."""
