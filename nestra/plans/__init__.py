"""Plan fragments and whole array programs."""
