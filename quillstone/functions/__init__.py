"""Part of the record review and preparation library."""
