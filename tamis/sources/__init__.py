"""Table schemas, domain views, and text documents."""
