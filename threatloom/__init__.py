"""Analytics over security documents, events, vectors and detection rules, as PySpark DataFrame operators."""
