"""Column expressions: parsing, masking, level names, severity arithmetic."""
