"""codaria: medical-coding analytics as PySpark DataFrame transformations."""
