"""Sources of pairloom."""
