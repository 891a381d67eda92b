"""The batch operators over streams."""
