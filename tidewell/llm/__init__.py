"""Training-data operators: ten corpus-scale jobs and the queries that apply them."""
