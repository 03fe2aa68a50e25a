"""Part of tierwise; see README.md."""
