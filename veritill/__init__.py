"""Commerce-decision analytics on Spark: DataFrame functions over intents, carts, reviews and scores."""
