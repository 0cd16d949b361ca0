"""Column functions: identities, JSON values."""
