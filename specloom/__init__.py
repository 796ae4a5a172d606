"""specloom: document-compliance and retrieval analytics as Spark DataFrame operators."""
