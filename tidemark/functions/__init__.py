"""Column expressions: JSON members, dates and ages, topic and key names."""
