"""Statistics and detectors, each a plan over DataFrames."""
