"""Edit logs and clock alignment over streams."""
