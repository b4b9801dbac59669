"""Event, journey and network analytics as plain DataFrame functions on Spark."""
