"""lumenframe: scientific tables on PySpark that refuse bad data instead of hiding it."""
