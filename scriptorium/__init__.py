"""Recognition-text analytics and corpus preparation as Spark plans."""
