"""plans of kinfold."""
