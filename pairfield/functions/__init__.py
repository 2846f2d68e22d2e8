"""Column functions: keyed draws and scalar geometry."""
