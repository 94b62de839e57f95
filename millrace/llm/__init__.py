"""Training-data operators (documents, pages, embeddings). Nothing else in the library imports this."""
