"""Column functions: label algebra, courts, text keys, quotes and documents."""
