"""What tables are read from and written to."""
