"""Files that a run leaves behind."""
