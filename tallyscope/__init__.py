"""Event-score analytics and corpus preparation on Spark."""
