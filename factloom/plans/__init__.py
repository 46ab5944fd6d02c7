"""Plans over the star-schema tables."""
