"""functions of quire."""
