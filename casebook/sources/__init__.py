"""Reading folders of loosely structured tables, and writing results."""
