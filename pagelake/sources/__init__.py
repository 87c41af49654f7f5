"""Sources: documents as files, bytes or tables; pages; ground truth; dimension tables."""
