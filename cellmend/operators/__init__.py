"""Detection, statistics, models, rules and helpers, each over DataFrames."""
