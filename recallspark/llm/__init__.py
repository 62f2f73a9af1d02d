"""Operators of a training-data pipeline. Nothing else in the library imports this package. Ids (doc_id, page_id, item_id) are longs, or are cast to long; texts that are no numbers are an error."""
