"""The catalogue of queries over the driver's tables, and the SQL each is held against."""
