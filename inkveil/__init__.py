"""Find, review and redact personal data in tables of documents, as Spark jobs."""
