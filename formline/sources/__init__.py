"""Reading, cleaning and writing of tables."""
