"""tokenlake: Spark-native byte-level corpus analytics and subword vocabulary induction."""
