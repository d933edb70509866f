"""The batch plans on files as they arrive."""
