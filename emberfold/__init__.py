"""emberfold: an analytics engine made of Spark DataFrames, SQL and Column functions."""
