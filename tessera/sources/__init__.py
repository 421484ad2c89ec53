"""Sources: files on disk to fact tables."""
