"""Training-data operators: ten corpus-preparation steps over documents, pages, conversations and vectors."""
