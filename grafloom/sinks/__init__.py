"""Where graphs are written: snapshots of the five tables, and payload files."""
