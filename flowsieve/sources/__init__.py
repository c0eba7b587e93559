"""Reading flow files and storing results."""
