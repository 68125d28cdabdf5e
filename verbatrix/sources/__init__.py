"""Where entries, vectors and other stores come from."""
