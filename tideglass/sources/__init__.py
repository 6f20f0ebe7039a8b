"""Sources of tideglass."""
