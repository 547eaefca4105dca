"""Rating prediction for (user, business) pairs as Spark DataFrame plans."""
