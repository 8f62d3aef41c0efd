"""kinfold: record linkage and analytics operators expressed as Spark DataFrame plans."""
