"""sources of kinfold."""
