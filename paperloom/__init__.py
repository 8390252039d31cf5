"""A PySpark engine that structures documents, indexes them and answers semantic queries over them."""
