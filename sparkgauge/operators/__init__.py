"""One module per operator family; every operator maps DataFrames to DataFrames."""
