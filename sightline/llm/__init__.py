"""Text, chat, link and vector operators for training-data pipelines over case records."""
