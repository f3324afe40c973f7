"""Sources: receivers that land payloads in files, and readers of what landed."""
