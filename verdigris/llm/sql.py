"""SQL twins of the text problems' queries, where SQL has them."""

SQL = {"p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
