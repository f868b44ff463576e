"""Reading transaction logs and writing results."""
