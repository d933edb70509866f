"""Readers and writers of tables, configuration and captured pages."""
