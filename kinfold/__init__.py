"""kinfold: entity resolution and corpus preparation as Spark plans."""
