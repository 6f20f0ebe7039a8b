"""Functions of tideglass."""
