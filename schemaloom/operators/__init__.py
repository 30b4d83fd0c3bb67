"""Operators over DataFrames: catalogs, validation, prompts, token statistics, plans, results and inference."""
