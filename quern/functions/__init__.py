"""functions of quern."""
