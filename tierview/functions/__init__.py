"""Value-level functions: array codec, addresses, boundary values."""
