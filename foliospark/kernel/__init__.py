"""The per-document kernel: tag grammar, Markdown, tree building and formatting, free of Spark."""
