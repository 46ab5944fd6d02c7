"""Graph building, validation, evaluation and integrity operators over DataFrames."""
