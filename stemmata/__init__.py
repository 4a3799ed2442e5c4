"""Text-reuse analytics over DataFrames: units, candidates, alignments, match records and their reports."""
