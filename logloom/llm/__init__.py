"""Training-data operators over a `documents(doc_id, text, lang, source, n_chars)` table.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
