"""operators of quern."""
