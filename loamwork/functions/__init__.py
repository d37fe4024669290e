"""Column expressions: text, spans, probability vectors, ids."""
