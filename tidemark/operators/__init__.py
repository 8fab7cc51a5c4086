"""``DataFrame -> DataFrame`` steps, usable on batch input and, unless noted, on streams."""
