"""Column functions: they take and return columns, shuffle nothing and work on streams too."""
