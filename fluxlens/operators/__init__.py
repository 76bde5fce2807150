"""Analytics and relational operators over flow DataFrames."""
